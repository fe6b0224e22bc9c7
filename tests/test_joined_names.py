"""Dictionaries that meet the words of the texts in a join."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names as N
from ledgerloom.functions.names import COLUMN, Names
from ledgerloom.operators import privacy
from ledgerloom.plans import demo_privacy

FIRST, LAST = ["kari", "per", *["n" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in range(60)]], ["hansen", "moen"]
TEXTS = ["Kari Hansen and per", "Per Moen met PER and Kari-Anne Hansen", "", None, "no names here", " ".join(f"{w.capitalize()} went." for w in FIRST), "kari kari Kari"]


@pytest.mark.parametrize("common", [1, 1 << 14])
def test_joined_as_listed(spark, monkeypatch, common):
    """The same spans and redacted texts as with the words in the plan, rows that are equal included, whether words are common or not; no part of the dictionary goes whole to anybody."""
    monkeypatch.setattr(N, "COMMON", common)
    listed = Names.listed(FIRST, LAST, ["per"])
    rows = [(w, "ambiguous" if w == "per" else "first") for w in FIRST] + [(w.upper(), "last") for w in LAST] + [("kari", "last"), ("", "first"), ("went", "other")]
    joined = Names.joined(spark.createDataFrame(rows, "token string, kind string"))
    texts = spark.createDataFrame([(t,) for t in TEXTS * 2], "t string")

    def found(names):
        df = names.on(texts, privacy.text_words(F.col("t"))).select("t", privacy.name_spans(F.col("t"), names).alias("s"))
        return sorted(((r["t"], r["s"]) for r in df.collect()), key=repr)

    assert found(joined) == found(listed) and len(found(joined)) == len(TEXTS) * 2
    out = privacy.redact_text(texts, "t", joined)
    assert COLUMN not in out.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, privacy.redact_text(texts, "t", listed).collect()), key=repr)
    people = spark.createDataFrame([("Kari Hansen", "x"), ("zz yy", "Moen"), (None, None)], "a string, b string")
    kinds = {"a": "FULL_NAME", "b": "LAST_NAME"}
    assert sorted(map(tuple, privacy.pseudonymize(people, kinds, names=joined).collect()), key=repr) == sorted(map(tuple, privacy.pseudonymize(people, kinds, names=listed).collect()), key=repr)
    with pytest.raises(ValueError, match="words"):
        joined.on(texts)


@pytest.mark.parametrize("query", ["name_spans_large", "name_spans_turned", "redact_text_large"])
def test_queries_take_dictionaries_of_any_size(spark, monkeypatch, query):
    """With a dictionary that is refused if it goes to every executor."""
    table = Names.table.__func__
    monkeypatch.setattr(Names, "table", classmethod(lambda cls, names, buckets=1 << 15, at_most=4_000_000: table(cls, names, buckets, 100)))
    from ledgerloom.plans import registry

    assert demo_privacy and registry.QUERIES[query](spark, "/root/testdata/sf0.001").count() == {"name_spans_large": 3000, "name_spans_turned": 1000, "redact_text_large": 1500}[query]


def test_gaps_beside_zero_characters(spark):
    df = spark.createDataFrame([("\x00a@b.no\x00\x00c@d.no",), ("a@b.no c@d.no",)], "t string")
    assert [[(s["start"], s["end"]) for s in r["s"]] for r in df.select(privacy.spans_of(F.col("t"), r"[a-z]@[a-z]\.no").alias("s")).collect()] == [[(1, 7), (9, 15)], [(0, 6), (7, 13)]]
