"""Previews of rows: the first in order, as the SQL has them."""

from ledgerloom.operators.relations import preview


def test_preview_orders_by_value_with_null_last(spark):
    rows = [(k, f"row {k}") for k in (100, 20, 3, None, 11)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)
    assert [tuple(r) for r in preview(df, ["k"]).collect()] == [("3", "row 3"), ("11", "row 11"), ("20", "row 20"), ("100", "row 100"), (None, "row None")]
    assert [r["k"] for r in preview(df, ["k"], 2).collect()] == ["3", "11"]


def test_ties_are_settled_by_the_other_columns(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id as v", "map('a', id) as m").repartition(7)
    assert [(r["k"], r["v"]) for r in preview(df, ["k"], 3).collect()] == [("0", "0"), ("0", "10"), ("0", "100")]


def test_text_is_trimmed_and_values_become_text(spark):
    df = spark.createDataFrame([(2, "  two  words ", 1.5, True), (1, " ", None, None), (3, None, -0.25, False)], "k int, v string, x double, b boolean")
    got = [tuple(r) for r in preview(df, ["k"], 25).collect()]
    assert got == [("1", "", None, None), ("2", "two  words", "1.5", "true"), ("3", None, "-0.25", "false")]
