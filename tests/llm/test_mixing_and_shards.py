"""Mixing, sharding, surrogates, embeddings and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.embeddings import embedding_components
from ledgerloom.llm.mixing import mix_sources, mixed_documents
from ledgerloom.llm.sharding import kd_shards
from ledgerloom.llm.surrogates import detect, dressed, luhn, surrogate, surrogate_map, with_surrogates

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes):
    left, budget, out = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, 1.5 * sum(sizes.values()), {}
    while left:
        level = (budget - sum(out.values())) / sum(left.values())
        full = [s for s, w in left.items() if level * w >= 2 * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in left.items()}
        for s in full:
            out[s] = 2 * sizes[s]
            left.pop(s)
    return out


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "en", "zz", 0), (-2, "", "en", None, 0), (-3, "four words in all", "en", None, 4), (-3, "four words in all", "en", None, 4), (None, "a b", None, "src1", 3)], DOCS))
    out, _ = mix_sources(docs)
    rows = out.collect()
    sizes = {(r["doc_id"], r["source"]): len((r["text"] or "").split()) for r in docs.collect()}
    by = {}
    for (_, s), n in sizes.items():
        by[s] = by.get(s, 0) + n
    by[None] += 4  # the repeated row
    want = targets(by)
    assert len(rows) == docs.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    own = {k: s for k, s in sizes}
    taken = {}
    for r in rows:
        s = own[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"], s] and r["source_size"] == by[s] and r["target"] == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(8, 0.1 * want[s])
    assert sorted(map(tuple, mix_sources(docs)[0].na.fill(-9).collect())) == sorted(map(tuple, out.na.fill(-9).collect()))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in rows if r["size"]) + sum(1 for _ in mixed.where("text is null or text = ''").collect())
    assert mix_sources(docs.limit(0))[0].count() == 0


def test_inclusion_frequencies(spark):
    """150 sources of 80 documents with the same sizes: each document is drawn as often as its inclusion probability says, and each source ends near its target."""
    sizes = [1, 2, 3, 5, 8, 8, 9, 30, 31, 33, 35, 100, 105, 110, 118, 150] * 5
    n, sources = len(sizes), 150
    length = F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % n + 1).cast("int"))
    docs = spark.range(sources * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") / n).cast("long")).alias("source"), F.array_join(F.array_repeat(F.lit("w"), length), " ").alias("text"))
    rows = mix_sources(docs, weights=(1,), share=1.3)[0].collect()
    drawn, taken = [0] * 16, {}
    for r in rows:
        drawn[r["doc_id"] % 16] += r["taken"] > r["size"]
        taken[r["doc_id"] // n] = taken.get(r["doc_id"] // n, 0) + r["taken"]
    assert all(r["taken"] in (r["size"], 2 * r["size"]) and r["target"] == pytest.approx(1.3 * sum(sizes)) for r in rows)
    shares = [d / (5 * sources) for d in drawn]
    # the seven smallest, which hold a twentieth of the words, make up for what the others miss
    assert all(abs(x - 0.3) < 0.06 for x in shares[7:]) and all(abs(x - 0.3) < 0.12 for x in shares[2:7]), shares
    # what is fixed is the number drawn of each class; sizes within one class differ by less than a tenth
    assert all(abs(t - 1.3 * sum(sizes)) <= 0.005 * sum(sizes) for t in taken.values())


def test_mix_ties_long_texts_and_clashing_names(spark):
    """Equal sources and sizes, repeated rows, a text of a million words, and columns named as those made on the way."""
    made = ["size", "rank", "class", "u", "plan_source", "drawn", "copy", "doc", "target"]
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), *[F.lit("x").alias(c) for c in made])
    long = docs.where("doc_id = 0").withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.repeat(F.lit("w "), 1_000_000))
    docs = docs.unionByName(docs.where("doc_id < 4")).unionByName(long)
    rows = mix_sources(docs)[0].collect()
    times = {}
    for r in rows:
        times.setdefault(r["doc_id"], set()).add(r["taken"])
    assert len(rows) == 45 and all(len(t) == 1 for t in times.values())
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in rows)


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "en", "x", 0), (None, "é", "en", "x", 1), (-3, "é", "en", "x", 1), (-3, "é", "en", "x", 1)], DOCS))
    rows = kd_shards(docs).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} == set(range(24))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    size = dict.fromkeys(range(24), 0)
    slots = {k: [] for k in range(24)}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.15 * min(size.values())
    assert kd_shards(docs.limit(0)).count() == 0 and len({r["shard"] for r in kd_shards(docs, target_bytes=10**9).collect()}) == 1


def test_shards_of_equal_values(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    counts = [r["count"] for r in kd_shards(docs, 7).groupBy("shard").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 3


def test_detect_and_dress():
    text = "Call Mrs. Anna Lopez at +1 (017) 555-7713 or ANNA@Ex.com; card 4111 1111 1111 1111, not 4111111111111112, ip 10.0.0.1, version 1.2.3.4.5, id 123-45-6789. Анна Петрова"
    spans = detect(text)
    assert [s[2].split("_")[0] for s in spans] == ["given", "family", "phone", "email", "card", "ip", "ssn", "given", "family"]
    new = [dressed(text[a:b], k, surrogate(b"k", k, p, 0)) for a, b, k, p in spans]
    assert new[0].endswith("a") and new[2].startswith("+1 (") and "@" in new[3] and luhn(new[4].replace(" ", "")) and len(new[4]) == 19 and all("А" <= c <= "я" for c in new[7])
    assert detect("") == [] and detect("plain words, version 3.0.") == []


def test_surrogates_are_one_to_one(spark):
    originals = spark.range(600).select(F.lit("ssn").alias("type"), F.lpad(F.col("id").cast("string"), 4, "0").alias("plain"))
    pairs = surrogate_map(originals.unionByName(originals), "k").collect()
    assert len(pairs) == len({r["surrogate"] for r in pairs}) == 600 and not {r["surrogate"] for r in pairs} & {r["plain"] for r in pairs}


def test_with_surrogates(spark):
    docs = spark.createDataFrame([(1, "Mail kari@x.com or KARI@X.COM."), (2, "kari@x.com again; 10.1.2.3"), (3, None), (4, ""), (5, "clean text"), (5, "clean text"), (None, "10.1.2.3")], "doc_id long, text string").withColumn("type", F.lit(1))
    rows = with_surrogates(docs, "key").collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    mail = text[2].split(" ")[0]
    assert len(rows) == 7 and mail in text[1] and text[1].lower().count(mail) == 2 and "kari" not in text[1].lower() and text[3] is None and text[4] == "" and text[5] == "clean text"
    assert text[2].split("; ")[1] == text[None] != "10.1.2.3"
    assert with_surrogates(docs.limit(0), "key").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = []
    for k in range(300):
        v = base[k % 60] + rng.standard_normal(16) * 0.03 * (k % 7)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    rows += [(300 + k, rows[5][1], 1) for k in range(40)]
    odd = [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0, None], 1), (404, rows[5][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1), (None, rows[5][1], 1), (408, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(df).collect()}
    good = rows + [(405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1)]
    links = []
    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[i + 1 :]:
            if p == q and len(x) == len(y):
                x_, y_ = np.float32(x).astype(float), np.float32(y).astype(float)
                if x_ @ y_ / np.sqrt(x_ @ x_) / np.sqrt(y_ @ y_) >= 0.98:
                    links.append((a, b))
    own = {k: k for k, _, _ in good}

    def root(n):
        while own[n] != n:
            n = own[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    for k, _, _ in good:
        assert got[k] == (sum(k in p for p in links), root(k), root(k) == k)
    assert all(got[k] == (0, k, True) for k in (400, 401, 402, 403, 404, 407, 408)) and got[None] == (0, None, True)
    assert embedding_components(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert 0 < len(rows) and {"doc_id", "shard", "slot"} <= set(out.columns)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        after = stage(spark, kept, DATA)
        assert after.columns == columns and after.join(kept, "doc_id", "left_anti").count() == 0, name
        kept = after


def test_mix_of_repeated_rows(spark):
    """Sources of one row that occurs 1,000 times, with an id and without one, beside one of rows with ids of their own."""
    row = lambda n, i, s: spark.range(n).select(F.lit(i).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit(s).alias("source"))
    own = spark.range(300).select("id", F.lit("a b").alias("text"), F.lit("c").alias("source")).withColumnRenamed("id", "doc_id")
    docs = row(1000, 7, "a").unionByName(row(1000, None, "b")).unionByName(own).repartition(7)
    rows = mix_sources(docs, weights=(1, 1, 1), share=1.1)[0]
    by = rows.groupBy(F.col("doc_id").isNull().alias("none"), F.col("size")).agg(F.first("target").alias("target"), F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert len(by) == 3 and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in by), by
    again = mix_sources(docs.repartition(3), weights=(1, 1, 1), share=1.1)[0]
    count = lambda df: sorted(((r["doc_id"] or -1, r["size"], r["taken"], r["count"]) for r in df.groupBy("doc_id", "size", "taken").count().collect()))
    assert count(again) == count(rows)  # whatever the partitions
    mixed = mixed_documents(docs, weights=(1, 1, 1), share=1.1)
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.when(F.col("source") == "c", 2).otherwise(3)).alias("n")).collect()}
    assert sorted(words.values()) == sorted(r["taken"] for r in by)


def test_shards_of_repeated_rows(spark):
    """A row that occurs 1,000 times, without an id, and rows that differ."""
    same = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs = same.unionByName(same.limit(200).withColumn("doc_id", F.lit(5).cast("long"))).repartition(6)
    rows = kd_shards(docs, 24).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 1200 and set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(len(s) - 50) <= 1 for s in slots.values()), {k: len(s) for k, s in slots.items()}
