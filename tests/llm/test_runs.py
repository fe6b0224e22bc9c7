"""Runs of words against brute force over all stretches, and the registered query against the contract in plain Python."""

import hashlib
import random
import zlib

import numpy as np

from ledgerloom.llm.queries import op12_periodic_runs
from ledgerloom.llm.runs import document_runs, run_digests, with_planted_repeats, word_runs

DATA = "/root/testdata/sf0.001"


def runs_of(words, least=12):
    """For each period, the stretches of equal words at that distance; those that a smaller period has too go."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def candidates(words, n):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return np.array(sorted(i for v in seen.values() if len(v) > 1 for i in v), np.int64)


def samples():
    rng = random.Random(12)
    for k in range(400):
        letters = rng.choice([1, 2, 3, 8])
        yield [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
    for k in range(150):
        words = []
        while len(words) < 120:
            base = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
            words += (base * rng.randrange(1, 6))[: rng.randrange(1, 60)]
        yield words
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    yield b  # many nested runs
    yield [0] * 700
    yield ([0] * 11 + [1]) * 40


def test_word_runs():
    some = 0
    for words in samples():
        for least in (12, 4):
            want = runs_of(words, least)
            assert word_runs(np.array(words, np.int64), candidates(words, (least + 1) // 2), least) == want
            some += len(want)
    assert some > 2000


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_of(words)
    kept = [True] * n
    for s, length, q in found:
        kept[s + q : s + length] = [False] * (length - q)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), sha(lines.encode()), sha(b" ".join(w for w, k in zip(words, kept) if k)))


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


def test_edge_rows(spark):
    line = "all of this stands here twice and more "
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (None, line * 5), (None, None), (5, line * 9 + "end"), (5, line * 9 + "end"),
        (6, "a " * 30), (7, "x y\x1cz  " * 20), (8, "æ ø " * 12), (9, "a b c d e f g h i j k l"), (10, "a b c d e f a b c d e f"),
        *[(k, " ".join(random.Random(k).choice("ab") for _ in range(60))) for k in range(100, 200)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 runs", "2 words", "3 a", "4 n", "5 collapsed")
    got = sorted(map(tuple, run_digests(document_runs(with_planted_repeats(docs))).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] for r in got) > 50
    plain = {r["doc_id"]: r for r in document_runs(docs.where("doc_id in (5, 10)")).collect()}
    assert plain[10]["runs"] == [(0, 12, 6)] and plain[10]["collapsed"] == "a b c d e f"
    assert plain[5]["collapsed"] == line + "end" and plain[5]["n_words"] == 73
    assert document_runs(docs.limit(0)).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in rows if len((r["text"] or "").split()) < 2500]
    assert len(rows) > 150
    known = {r[0] for r in rows}
    got = sorted((tuple(r) for r in op12_periodic_runs(spark, DATA).collect() if r["doc_id"] in known), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key) and sum(r[1] for r in got) > 5


def test_long_text(spark):
    """120,000 words, a stretch of 7,001 words three times over and one word 40,000 times."""
    rng = random.Random(5)
    part = [f"w{rng.randrange(10**6)}" for _ in range(7001)]
    words = [f"u{k}" for k in range(30000)] + part * 3 + ["end"] + ["same"] * 40000 + [f"v{k}" for k in range(25000)]
    row = document_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert row["runs"] == [(30000, 21003, 7001), (51004, 40000, 1)]
    assert row["collapsed"].split() == words[:37001] + ["end", "same"] + words[-25000:]
