"""N-gram join, line dedup and decontamination against brute force, and their edge cases."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.decontamination import decontaminated, leaks
from ledgerloom.llm.lines import line_decisions, normalised, without_repeats
from ledgerloom.llm.ngram_join import ngram_components, one_of_each_group

DATA = "/root/testdata/sf0.001"
EDGE = [(None, "a null id of some words here"), (900001, None), (900002, ""), (900003, " \n\t"), (900004, "two words"), (900005, "TWO words"), (900006, "one"), (900007, "x " * 30_000), (900008, "x " * 30_000), (900009, "same same same same same same")]


def groups(links, nodes):
    own = {n: n for n in nodes}

    def root(n):
        while own[n] != n:
            n = own[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_components(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(EDGE, "doc_id long, text string")).withColumn("node", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    sets = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs).collect()}
    assert got.pop(None) == (3, None)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}
    assert len(links) > 5


def test_ngram_ties_repeats_and_empty(spark):
    words = [f"w{k}" for k in range(103)]
    near = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join([*words[:80], *(f"v{k}" for k in range(23))])), (4, " ".join(["q", *words[1:60], "r", *words[61:]]))]
    sets = {k: shingles(t) for k, t in near}
    want = groups([(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_components(df).collect()) == sorted((k, want[k]) for k, _ in near)
    assert sorted(r["doc_id"] for r in one_of_each_group(df).collect()) == sorted({want[k] for k in sets})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).count() == 0 and one_of_each_group(empty).count() == 0


def test_large_group_of_near_copies(spark):
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(120):
        w = list(base)
        for j in range(k % 9):
            w[(k * 37 + j * 17) % 150] = f"e{k}_{j}"
        docs.append((k, " ".join(w)))
    sets = {k: shingles(t) for k, t in docs}
    want = groups([(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    assert {r["doc_id"]: r["component_id"] for r in ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = [(1, f"First line of all.\n{long}\n\nfirst  LINE of all."), (2, f"{long} tail\nAnother thing entirely."), (3, "another thing entirely."), (4, None), (5, ""), (6, "\n \n"), (None, "Another thing entirely.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_decisions(df).collect()}
    assert got[None] == (1, []) and got[1] == (3, [3]) and got[3] == (1, [0]) and got[4] == (0, []) and got[5] == (0, []) and got[6] == (0, [])
    assert got[2][1] in ([1], [0, 1])  # the long line links if its SimHash differs in 3 bits or fewer
    text = {r["doc_id"]: r["text"] for r in without_repeats(df).collect()}
    assert text[1] == f"First line of all.\n{long}\n" and text[3] == "" and text[4] is None and text[5] == ""
    assert line_decisions(df.limit(0)).count() == 0


def test_lines_brute_force(spark):
    """All that go are equal or linked by similarity to an earlier line; all equal lines but the first go."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    text = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    norm = {(r["doc_id"], k): r["l"][k] for r in docs.select("doc_id", F.transform(F.split("text", "\n"), normalised).alias("l")).collect() for k in range(len(r["l"])) if r["l"][k]}
    gone = {(r["doc_id"], k) for r in line_decisions(docs).collect() for k in r["dropped"]}
    first = {}
    for place in sorted(norm):
        first.setdefault(norm[place], place)
    assert {p for p in norm if first[norm[p]] != p} <= gone
    for p in gone:
        if first[norm[p]] == p:
            assert any(_distance(norm[p][:300], norm[q][:300]) <= 0.25 * max(len(norm[p][:300]), len(norm[q][:300])) + 60 for q in norm if q < p)
    assert text


def test_near_lines_are_in_one_group(spark):
    """Every brute-force near pair is in one group, and no group joins lines without a chain of near pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    lines = ["de.", "die.", "del.", "con.", "on.", "abcdefgh", "abxdeffh", "x" * 40 + "abcdefghij" * 6, "x" * 40 + "abcdefghij" * 5 + "abc-efghij"]
    for n in (2, 4, 7, 10, 20, 28, 60):
        for _ in range(6):
            w = [word() for _ in range(n)]
            lines.append(" ".join(w))
            for changed in {1, max(1, n // 12), max(1, n // 7)}:
                v = list(w)
                for k in rng.sample(range(n), changed):
                    v[k] = word()
                lines.append(" ".join(v))
    lines = list(dict.fromkeys(lines))
    links = [(a, b) for a, b in combinations(range(len(lines)), 2) if _distance(lines[a], lines[b]) <= 0.25 * max(len(lines[a]), len(lines[b])) + 1e-9]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = groups(links, range(len(lines)))
    assert len(links) > 60
    assert {r["doc_id"]: r["n_dropped"] for r in line_decisions(df).collect()} == {k: int(want[k] != k) for k in want}


QUESTION = "If Maria Lopez buys 12 apples at 3 euros each and then sells 5 of them to Peter Hansen for 20 euros how much money does she have left at the end of the day?"


def test_leaks(spark):
    plain = "the quick brown fox jumps over the lazy dog while seven careful wizards quietly box up extra jugs of daily vinegar for nobody in particular"
    docs = [
        (1, f"Some text before. {plain.upper()}! And after."),
        (2, QUESTION.replace("Maria Lopez", "Greta Olsen").replace("12", "40").replace("Peter Hansen", "Jan Berg").replace("apples", "apples")),
        (3, "Nothing of the kind stands here, only ordinary words in an ordinary order, with no question at all."),
        (4, None), (5, ""), (6, "the quick brown fox jumps over the lazy cat"), (None, plain), (7, plain), (7, plain),
    ]
    items = [(10, plain), (11, f"Question. {QUESTION}"), (12, "too short"), (None, plain), (13, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()) == [(1, 10), (2, 11), (7, 10)]
    assert sorted(r["doc_id"] or 0 for r in decontaminated(d, b).collect()) == [0, 3, 4, 5, 6]
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "Add 7 to 7 and 7 to 7 and then write 7 in the box next to 7 and 7 under it because 7 is the number of days here"
    other = item
    for k, v in enumerate((11, 23, 35, 47, 59, 61, 73, 85)):
        other = other.replace(" 7", f" {v}", 1)
    d = spark.createDataFrame([(1, item.replace("7", "9")), (2, other)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in leaks(d, b).collect()] == [1]


def test_each_occurrence_is_judged_alone(spark):
    other = QUESTION.replace("Maria Lopez", "Greta Olsen").replace("12", "40").replace("3", "8").replace("20", "90").replace("Peter Hansen", "Jan Berg")
    third = QUESTION.replace("Maria Lopez", "Olga Braun").replace("12", "77").replace("5", "6").replace("Peter Hansen", "Luis Sommer")
    d = spark.createDataFrame([(1, f"{QUESTION} {other}"), (2, f"{other} Some words between. {third} {QUESTION}")], "doc_id long, text string")
    b = spark.createDataFrame([(1, QUESTION), (2, other)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_short_dense_and_rewrapped_items(spark):
    dense = "3 4 5 6 plus 7 8 9 10 plus 11 12 13 14"
    tom = "Tom has 5 apples in his bag. Tom gives 3 of them to Anna today. Tom then eats 1 more of them."
    items = [(1, "which planet is the largest"), (2, dense), (3, tom), (4, QUESTION)]
    docs = [(1, "He asked: WHICH planet\nis the largest? Nobody knew."), (2, f"Compute {dense} now"), (3, tom.replace("Tom", "Greta").replace("5", "9")), (4, QUESTION.upper()), (5, QUESTION.replace(" Maria", "\nMaria").replace(" Peter", "\nPeter").lower()), (6, re.sub(r"\d+", lambda m: str(int(m[0]) + 20), dense)), (7, "which planet is the smallest")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]


def test_leaks_against_plain_13_grams(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", t.lower())
    texts = {r["doc_id"]: " " + " ".join(words(r["text"])) + " " for r in docs.collect()}
    want = {(k, r["item_id"]) for r in items.collect() for w in [words(r["text"])] for k, t in texts.items() if any(f" {' '.join(w[j : j + 13])} " in t for j in range(len(w) - 12))}
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == want and want


def test_columns_that_clash_with_names_made_on_the_way(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, "what is the capital of the old kingdom by the sea"), (4, None)]
    made = ["gone", "again", "leaked_id", "gone_id", "dropped", "component_id", "first", "line", "window", "node"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in made])
    benchmark = spark.createDataFrame([(7, rows[3][1])], "item_id long, text string")
    kept, clean, cut = one_of_each_group(docs), decontaminated(docs, benchmark), without_repeats(docs)
    assert all(out.columns == docs.columns for out in (kept, clean, cut))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 2, 4]
    assert sorted((r["doc_id"], r["text"]) for r in cut.where("text is not null").collect()) == [(1, rows[0][1]), (2, ""), (2, ""), (3, rows[3][1])]
