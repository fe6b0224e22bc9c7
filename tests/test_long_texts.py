"""Texts that make patterns repeat very often: no stack runs out, and the time stays in bounds."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import decoding as D
from ledgerloom.operators import privacy as P
from ledgerloom.sources import readers

TEXTS = {
    "digits": "1" * 200_000, "groups": "12 " * 20_000, "phones": "22 33 44 55, " * 5_000, "one row of phones": "22334455 " * 3_000, "blanks": " " * 200_000, "words": "ab " * 60_000, "marks": "a@" * 50_000,
    "labels": "x@" + "a." * 50_000, "places": "1234 OSLO " * 10_000, "capitals": "1234 " + "A " * 50_000, "hyphens": "a-" * 50_000, "escapes": "\\u0041" * 50_000, "names": "Kari Hansen " * 10_000,
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_spans_and_decoding(spark, name):
    df = spark.createDataFrame([(TEXTS[name],)], "t string")
    t = F.col("t")
    began = time.time()
    ids, names, plain, entities = df.select(F.size(P.pii_spans(t)), F.size(P.name_spans(t)), F.length(D.unescaped(t)), F.length(D.decoded_entities(t))).first()
    assert time.time() - began < 60
    want = {"phones": (5_000, 0), "one row of phones": (3_000, 0), "places": (10_000, 0), "names": (0, 5_000)}
    if name in want:
        assert (ids, names) == want[name]
    assert plain == (50_000 if name == "escapes" else len(TEXTS[name])) and entities <= len(TEXTS[name])


def test_rows(spark, tmp_path):
    base = tmp_path / "a/content/s/t"
    base.mkdir(parents=True)
    (base / "x.xml").write_text("<table>" + " \n" * 100_000 + "<!-- c -->" * 5 + "<row><c1>1</c1></row>" + "<!-- c --> " * 5_000 + "<row><c1>1</c1></row>" + "\n" * 100_000 + "</table>")
    assert readers.row_faults(spark, str(tmp_path / "a/content")).collect() == []
