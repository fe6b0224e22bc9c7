"""Containers, decoding, spans, names, pairing and numbering beyond what the SQL twins show."""

import bz2
import gzip
import io
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions.names import COLUMN, Names
from ledgerloom.functions.text import let
from ledgerloom.operators import catalog, lobs, privacy, relations


def zipped(names, **kinds):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, b"some words " * 50)
    return bytearray(out.getvalue())


def test_damaged_and_locked_containers(spark):
    whole, locked, bad = bytearray(gzip.compress(b"abc" * 500)), zipped(["a"]), zipped(["a"])
    cut = whole[: len(whole) // 2]
    twisted = bytearray(whole)
    twisted[12:16] = b"\xff\xff\xff\xff"
    for at in (6, locked.index(b"PK\x01\x02") + 8):
        locked[at] |= 1
    bad[40:60] = b"\xff" * 20
    rows = {"whole": whole, "cut": cut, "twisted": twisted, "locked": locked, "bad": bad, "many": zipped(["a", "b"]), "one": zipped(["a"]), "bz": bytearray(b"\x00\x00\x00\x09" + bz2.compress(b"xyz")), "none": None, "plain": bytearray(b"plain text, no container")}
    inv = spark.createDataFrame([(k, None if v is None else bytes(v)) for k, v in rows.items()], "path string, content binary")
    got = {r["path"]: (r["route"], r["content"]) for r in lobs.recover_payload(inv).collect()}
    assert {k: v[0] for k, v in got.items()} == {"whole": "gz", "cut": "broken", "twisted": "broken", "locked": "encrypted", "bad": "broken", "many": "as_is", "one": "zip", "bz": "bz2", "none": "as_is", "plain": "as_is"}
    assert got["whole"][1] == b"abc" * 500 and got["cut"][1] == bytes(cut) and got["bz"][1] == b"xyz" and got["none"][1] is None
    small = {r["path"]: r["route"] for r in lobs.recover_payload(inv, largest=100).collect()}
    assert small["whole"] == "oversize" and small["bz"] == "bz2"
    profile = {r["path"]: (r["kind"], r["members"], r["bytes"]) for r in lobs.container_profile(inv).collect()}
    assert profile == {"whole": ("gz", 1, 1500), "cut": ("broken", 0, 0), "twisted": ("broken", 0, 0), "locked": ("encrypted", 0, 0), "bad": ("broken", 0, 0), "many": ("zip", 2, 1100), "one": ("zip", 1, 550), "bz": ("bz2", 1, 3)}


def test_hex_text_of_other_encodings(spark):
    cells = spark.createDataFrame([("t", 0, 1, "Blåbær".encode("cp1252").hex()), ("t", 1, 1, b"a\x01b\tc".hex()), ("t", 2, 1, "é".encode().hex())], "table_key string, row_pos long, col_idx int, value string")
    assert [r["text"] for r in lobs.extract_hex(cells).orderBy("row_pos").collect()] == ["Blåbær", "a�b\tc", "é"]


def test_placeholders_missing_or_double(spark):
    inv = spark.createDataFrame([("a.pdf", "pdf"), ("b.xyz", "xyz")], "path string, ext string")
    none = spark.createDataFrame([("pdf", bytearray(b"p")), ("pdf", bytearray(b"q"))], "kind string, content binary")
    assert sorted((r["path"], r["kind"], r["new_length"]) for r in lobs.replace_lobs(inv, none).collect()) == [("a.pdf", "pdf", 1), ("b.xyz", "bin", 0)]


def spans(spark, text, of):
    rows = spark.createDataFrame([(text,)], "t string").select(of(F.col("t")).alias("s")).collect()[0]["s"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    return [(r["type"], r["text"]) for r in rows]


def test_name_spans(spark):
    cases = {
        "Kari Hansen called.": [("FULL_NAME", "Kari Hansen")],
        "Anna Qvist and Bo Quist": [("FULL_NAME", "Anna Qvist")],
        "Øvergård, Lars wrote; Mary too": [("FULL_NAME", "Øvergård, Lars"), ("FIRST_NAME", "Mary")],
        "ten kroner per dag": [],
        "Per Moen": [("FULL_NAME", "Per Moen")],
        "Anna Mary Kari Qvist Hansen": [("FULL_NAME", "Anna Mary Kari Qvist")],
        "Hansen alone": [],
        "æ ø å: John O'Neil-Berg": [("FULL_NAME", "John O'Neil-Berg")],
        "": [],
    }
    for text, want in cases.items():
        assert spans(spark, text, privacy.name_spans) == want, text
    assert spans(spark, "Wei Chen and Anna Berg", lambda c: privacy.name_spans(c, Names.listed(["wei"], ["chen"]))) == [("FULL_NAME", "Wei Chen")]
    assert spark.range(1).select(privacy.name_spans(F.lit(None).cast("string")).alias("s")).collect()[0]["s"] == []


def test_pii_spans(spark):
    text = "id 01819910150, mail a.b@x.example.org; 0150 OSLO SENTRUM, tel +47 22 33 44 55 and 22334455.pdf"
    assert spans(spark, text, privacy.pii_spans) == [("FNR", "01819910150"), ("EMAIL", "a.b@x.example.org"), ("POSTNR", "0150 OSLO SENTRUM"), ("PHONE", "+47 22 33 44 55")]
    assert spans(spark, "x" * 200_000, privacy.pii_spans) == []


def test_numbers_among_others(spark):
    """Numbers that stand in a row with others; groups; numbers that are none."""
    cases = {
        "a 12 01819910150 22334455 b": [("FNR", "01819910150"), ("PHONE", "22334455")],
        "018199 10150": [("FNR", "018199 10150")],
        "018 199 10150": [],
        "+47 223 34 455, 0047 22334455": [("PHONE", "+47 223 34 455"), ("PHONE", "0047 22334455")],
        "x22334455 22334455x 12345678": [],
        "1 2 3 4 5 6 7 8 9": [("PHONE", "2 3 4 5 6 7 8 9")],
    }
    for text, want in cases.items():
        assert spans(spark, text, privacy.pii_spans) == want, text


def test_spans_of_many_matches(spark):
    """Places over several blocks of matches; the time grows with the matches."""
    import time

    text = "".join(f"æ{'x' * (k % 7)} a{k}@b.no " for k in range(1000))
    got = spans(spark, text, privacy.pii_spans)
    assert got == [("EMAIL", f"a{k}@b.no") for k in range(1000)]
    seconds = []
    for n in (4_000, 4_000, 16_000):
        df = spark.createDataFrame([("ab@c.no, 22334455 " * n,)], "t string").select(F.size(privacy.spans_of(F.col("t"), "[a-z]+@")).alias("n"), F.size(privacy.spans_of(F.col("t"), "[0-9]+")).alias("m"))
        began = time.time()
        assert tuple(df.first()) == (n, n)
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 1


def test_spans_apart(spark):
    """Against a plain comparison of all with all."""
    import random

    rng = random.Random(2)
    kind = "array<struct<start:int,end:int>>"
    rows = []
    for _ in range(60):
        taken, at = [], 0
        for _ in range(rng.randrange(0, 40)):
            at += rng.randrange(0, 9)
            taken.append((at, at + rng.randrange(1, 9)))
            at = taken[-1][1]
        rows.append(([(a, a + rng.randrange(1, 12)) for a in (rng.randrange(0, 300) for _ in range(30))], taken))
    got = spark.createDataFrame(rows, f"s {kind}, t {kind}").select("s", "t", let(F.col("t"), lambda t: privacy._apart(F.col("s"), t)).alias("left")).collect()
    for r in got:
        assert r["left"] == [s for s in r["s"] if not any(s["start"] < t["end"] and t["start"] < s["end"] for t in r["t"])]


def test_dictionary_as_table(spark):
    """The same spans from a table as from a list, whatever stands in it; a plan that does not grow; a bound."""
    rows = [("Kari", "first"), ("per", "ambiguous"), ("PER", "last"), ("hansen", "last"), ("moen", "last"), (None, "first"), ("x", "other"), (" ", "first"), ("moen", "last")]
    listed = Names.listed(["kari", "per"], ["hansen", "moen"], ["per"])
    texts = spark.createDataFrame([("Kari Hansen and per Moen, ten per dag. KARI",), ("",), (None,), ("Hansen",)], "t string")

    def found(names):
        return [r["s"] for r in names.on(texts).select("t", privacy.name_spans(F.col("t"), names).alias("s")).orderBy("t").collect()]

    table = Names.table(spark.createDataFrame(rows, "token string, kind string"), 64)
    assert found(table) == found(listed) and len(found(table)[3]) == 3
    large = Names.table(spark.range(100_000).select(F.translate(F.concat(F.lit("n"), "id"), "0123456789", "abcdefghij").alias("token"), F.lit("first").alias("kind")))
    plan = lambda names: len(privacy.redact_text(texts, "t", names)._jdf.queryExecution().analyzed().toString())
    assert abs(plan(large) - plan(table)) < 0.05 * plan(table)
    assert [len(s) for s in found(large)] == [0, 0, 0, 0]
    assert COLUMN not in privacy.redact_text(texts, "t", table).columns
    assert sorted(r["n_redacted"] for r in privacy.redact_text(texts, "t", table).collect()) == [0, 0, 0, 3]
    few = Names.table(spark.createDataFrame(rows, "token string, kind string"), 64, at_most=3)
    try:
        found(few)
        raise AssertionError("a dictionary beyond the bound was taken")
    except Exception as e:
        assert "more than 3 names" in str(e)


def test_base_names(spark):
    names = {"Persontmp": "Person", "Sak2023": "Sak", "a_2023_01": "a", "v 12_2023": "v 12", "x_20": "x_20", "2023": "", "arkiv_sikkerhetskopi-20230101 bak": "arkiv", "Person_tmp": "Person", "Person_2023": "Person", "Sak kopi_20230101": "Sak", "Person_2023-01-05_bak": "Person", "Sak": "Sak", "tmp": "", "A1_copy-backup": "A1"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", catalog.base_name(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in rows} == names


def test_pairs_of_documents(spark):
    rows = spark.createDataFrame([(1, 1, "m"), (1, 2, "b"), (1, 2, "a"), (2, 1, "alone"), (None, 1, "null"), (None, 2, "data"), (3, 2, "no main"), (1, 1, "second")], "case long, seq int, text string")
    out = relations.pair_documents(rows, "case", "seq", ["text"])
    assert sorted(((r["case"], r["text"], r["data"] and r["data"]["text"]) for r in out.collect()), key=str) == [(1, "m", "a"), (1, "second", "a"), (2, "alone", None), (None, "null", None)]
    assert tuple(relations.pair_counts(out).first()) == (4, 2, 2)
    assert tuple(relations.pair_counts(relations.pair_documents(rows.limit(0), "case", "seq", ["text"])).first()) == (0, 0, 0)


def test_budget_of_children(spark):
    rows = {"p": spark.createDataFrame([(k, k) for k in range(6)], "row_pos long, id long"), "c": spark.createDataFrame([(k, k % 6) for k in range(60)], "row_pos long, pid long")}
    key = relations.ForeignKey("f", "c", ("pid",), "p", ("id",))

    def kept(budget):
        keep = relations.referential_subset(rows, [key], 3, important=["p"], budget=budget)
        return sorted(r["row_pos"] for r in keep["c"].collect())

    seeds = [0, 20, 40]
    assert kept(100) == sorted({*seeds, 0, 6, 12, 2, 8, 14, 4, 10, 16})
    assert kept(8) == sorted([*seeds, 6, 12])  # row 0 is a seed and costs nothing
    assert kept(6) == seeds  # the one child that comes on top is a seed


def test_numbered(spark):
    rows = spark.createDataFrame([(g, k) for g in ("a", "b", None) for k in range(50)], "g string, k int")
    assert all(r["at"] == r["k"] + 1 for r in relations.numbered(rows, "g", ["k"]).collect())
