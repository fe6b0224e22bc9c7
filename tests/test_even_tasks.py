"""Work that is dealt out to all tasks, whatever the groups and files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lobs, relations as R
from ledgerloom.plans import demo_intake, demo_privacy, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """Joins by shuffle, as large tables have them, without what the engine mends at run time."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_large_group_is_numbered_by_many_tasks(plain):
    df = plain.range(4000).select(F.when(F.col("id") % 100 == 0, "few").when(F.col("id") % 101 == 0, None).otherwise("many").alias("g"), (F.col("id") * 7919 % 4001).alias("v"))
    out = R.numbered(df, "g", ["v"])
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows if r["g"] == "many"}) > 1
    for g in ("few", "many", None):
        own = sorted((r["v"], r["at"]) for r in rows if r["g"] == g)
        assert own and [at for _, at in own] == list(range(1, len(own) + 1))


def test_rows_of_one_table_are_read_by_many_tasks(plain):
    assert registry.QUERIES["lob_refs"](plain, DATA).count() == 1200
    counts = registry.QUERIES["rows_round_trip"](plain, DATA).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(counts) > 1 and sum(r["count"] for r in counts) == 1500


@pytest.mark.parametrize(("query", "sinks"), [("rows_round_trip", 1), ("failed_from_files", 2)])
def test_files_grow_in_number(spark, monkeypatch, query, sinks):
    made, folder = [], demo_intake._folder
    monkeypatch.setattr(demo_intake, "_folder", lambda i, name: made.append(folder(i, name)) or made[-1])
    registry.QUERIES[query](spark, DATA).count()
    assert [len(list(Path(p.removeprefix("file:")).glob("part-*"))) for p in made] == [4] * sinks


def test_inline_content_is_not_dealt_out(spark, monkeypatch):
    """Only what the names need is numbered."""
    seen, numbered = [], lobs.numbered
    monkeypatch.setattr(lobs, "numbered", lambda df, *a: seen.append(df.columns) or numbered(df, *a))
    cells = spark.createDataFrame([("t", 2, 3, "b" * 9), ("t", 1, 3, "41" * 9), ("u", 0, 3, "")], "table_key string, row_pos long, col_idx int, value string")
    assert sorted(tuple(r) for r in lobs.extract_inline(cells).collect()) == [("t", 1, "hex", "rec1.txt", 9, "txt"), ("t", 2, "text", "rec2.txt", 9, "txt")]
    assert not {"value", "content"} & set(seen[0])


@pytest.mark.parametrize("query", ["pii_spans", "name_spans", "redact_text", "pseudonymize_names"])
def test_people_of_one_split_are_dealt_out(spark, query):
    assert demo_privacy and registry.QUERIES[query](spark, DATA).rdd.getNumPartitions() >= 4


def test_only_columns_that_tell_kept_ones_apart_are_sorted(spark, monkeypatch):
    """Rows of lineitem keep three keys, the first of the order: the rest is neither shuffled nor sorted. A key that is not in the order, or none, leaves it whole."""
    seen, put = [], R.materialized
    monkeypatch.setattr(R, "materialized", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), put(df))[1])
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    keys = ["l_suppkey", "l_orderkey", "l_partkey"]
    rows = R.with_row_pos(lines, lines.columns, keep=iter(keys)).collect()
    above = seen[0].split("Relation")[0]
    assert "l_shipdate" not in above and "l_linenumber" not in above
    expected = sorted((r["l_orderkey"], r["l_partkey"], r["l_suppkey"]) for r in lines.collect())
    assert [(r["l_orderkey"], r["l_partkey"], r["l_suppkey"]) for r in sorted(rows, key=lambda r: r["row_pos"])] == expected
    assert [r["row_pos"] for r in sorted(rows, key=lambda r: r["row_pos"])] == list(range(len(expected)))
    assert R._telling(["a", "b", "c"], ["b"]) == ["a", "b"] and R._telling(["a", "b"], ["d"]) == R._telling(["a", "b"], None) == ["a", "b"]
