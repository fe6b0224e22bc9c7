"""Example tables for column functions."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import privacy as P
from ledgerloom.operators import relations as R


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,valid", [("98765432", True), ("+47 98 76 54 32", True), ("004798765432", True), ("4798765432", True), ("2017-2020", False), ("12345678", False), ("9876543", False), ("", False), (None, False), ("98765432.doc", False)])
def test_phone(spark, value, valid):
    assert one(spark, T.phone_valid, value) is valid


@pytest.mark.parametrize("value,valid", [("01819910150", True), ("018199 10150", True), ("12345678901", False), ("0181991015", False), (None, False)])
def test_id_number(spark, value, valid):
    assert one(spark, T.id_number_valid, value) is valid


def test_fake_id_number_is_valid_and_stable(spark):
    df = spark.range(200).select(F.lpad((F.col("id") * 97531 + 1010112345).cast("string"), 11, "0").alias("v"))
    df = df.select(T.fake_id_number(F.col("v")).alias("a"), T.fake_id_number(F.col("v")).alias("b"))
    assert df.where(~T.id_number_valid(F.col("a")) | (F.col("a") != F.col("b"))).count() == 0
    assert one(spark, T.fake_id_number, "12345") != "12345" and len(one(spark, T.fake_id_number, "12345")) == 5


@pytest.mark.parametrize("value,is_file", [("a.pdf", True), ("Letter.DOCX", True), ("kari@mail.no", False), ("text", False), (None, False)])
def test_file_name(spark, value, is_file):
    assert one(spark, T.looks_like_file, value) is is_file


@pytest.mark.parametrize("value,shaped", [("KARI HANSEN", True), ("Ola von Tveit", True), ("Ordinary school", False), ("SFO", False), ("Kari 2", False), ("Unni Ødegård", True), ("", False)])
def test_name_shape(spark, value, shaped):
    assert one(spark, lambda v: T.name_shape(v, lambda w: w.isin(*P.KNOWN_FIRST, *P.KNOWN_LAST)), value) is shaped


def test_case_is_kept_and_no_name_maps_to_itself(spark):
    df = spark.createDataFrame([(n.capitalize(),) for n in P.KNOWN_LAST], "v string").select("v", P.stand_in("LAST_NAME", F.upper("v")).alias("up"), P.stand_in("LAST_NAME", F.col("v")).alias("same"))
    assert df.where("up != upper(up) or upper(same) != up or same = v").count() == 0


@pytest.mark.parametrize("value,out", [("a\\u0020\\u0020b\\u0020", "a b"), ("\\u0020", ""), ("plain", "plain")])
def test_padding(spark, value, out):
    assert one(spark, T.clean_padding, value) == out


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([("Ring Kari Hansen, 01819910150 eller kari@mail.no.",), ("nothing here",), (None,)], "t string")
    rows = [r["t"] for r in P.redact_text(df, "t").collect()]
    assert rows[1:] == ["nothing here", None]
    assert rows[0].startswith("Ring ") and not any(x in rows[0] for x in ("Kari", "Hansen", "01819910150", "kari@")) and rows[0].endswith(".")


def test_closure_with_a_cycle(spark):
    rows = {"a": spark.createDataFrame([(0, 1, 1), (1, 2, None), (2, 3, 2)], "row_pos long, id int, up int")}
    fk = R.ForeignKey("self", "a", ("up",), "a", ("id",))
    keep = R.close_parents({"a": spark.createDataFrame([(2,)], "row_pos long")}, {"self": R.fk_edges(rows["a"], rows["a"], fk)}, [fk])
    assert sorted(r[0] for r in keep["a"].collect()) == [1, 2]


def test_null_keys_and_last_duplicate_parent(spark):
    child = spark.createDataFrame([(0, 1), (1, None)], "row_pos long, k int")
    parent = spark.createDataFrame([(0, 1), (5, 1)], "row_pos long, id int")
    assert [tuple(r) for r in R.fk_edges(child, parent, R.ForeignKey("f", "c", ("k",), "p", ("id",))).collect()] == [(0, 5)]
