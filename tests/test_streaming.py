"""Streams: counts that go on where an earlier run stopped or failed."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import intake
from ledgerloom.streaming.intake import live_counts, start_counts

HEADS = {"pdf": "%PDF-1.4 ", "xml": "<?xml version='1.0'?>", "txt": "plain "}


def arrive(spark, source, name, kinds):
    rows = [(f"{name}{k}", None, len(HEADS[x]), bytearray(HEADS[x].encode())) for k, x in enumerate(kinds)]
    spark.createDataFrame(rows, intake.FILES).coalesce(1).write.mode("append").parquet(source)


def state(spark, target):
    return {r["ext"]: (r["count"], r["bytes"], r["batch"]) for r in live_counts(spark, target).collect()}


def test_counts_go_on(spark, tmp_path):
    source, target, point = (f"file://{tmp_path}/{x}" for x in ("in", "out", "point"))
    arrive(spark, source, "a", ["pdf", "pdf", "txt"])
    arrive(spark, source, "b", ["xml"])
    first = start_counts(spark, source, target, point, "parquet", 1)
    first.awaitTermination()
    assert sum(p["numInputRows"] for p in first.recentProgress) == 4 and first.recentProgress[-1]["batchId"] >= 1
    assert {k: v[:2] for k, v in state(spark, target).items()} == {"pdf": (2, 18), "txt": (1, 6), "xml": (1, 21)}
    arrive(spark, source, "c", ["pdf", "xml", "xml"])
    second = start_counts(spark, source, target, point, "parquet", 1)
    second.awaitTermination()
    assert sum(p["numInputRows"] for p in second.recentProgress) == 3  # only what is new was read
    now = state(spark, target)
    assert {k: v[:2] for k, v in now.items()} == {"pdf": (3, 27), "txt": (1, 6), "xml": (3, 63)}
    assert now["txt"][2] < now["pdf"][2] == now["xml"][2]  # a batch writes what it changed


def test_failed_batch(spark, tmp_path, monkeypatch):
    """The sink fails in the second batch, after it has written; the next start runs that batch again and counts it once."""
    source, target, point = (f"file://{tmp_path}/{x}" for x in ("in", "out", "point"))
    arrive(spark, source, "a", ["pdf"])
    start_counts(spark, source, target, point, "parquet").awaitTermination()
    arrive(spark, source, "b", ["pdf", "txt"])
    spark.range(1).select(F.lit("pdf").alias("ext"), F.lit(99).cast("long").alias("count"), F.lit(0).cast("long").alias("bytes")).write.parquet(f"{target}/batch=1")
    assert state(spark, target)["pdf"][0] == 99  # as a crash between write and commit could leave it
    start_counts(spark, source, target, point, "parquet").awaitTermination()
    assert {k: v[0] for k, v in state(spark, target).items()} == {"pdf": 2, "txt": 1}


def test_nothing_arrives(spark, tmp_path):
    source, target, point = (f"file://{tmp_path}/{x}" for x in ("in", "out", "point"))
    arrive(spark, source, "a", ["txt"])
    start_counts(spark, source, target, point, "parquet").awaitTermination()
    before = state(spark, target)
    again = start_counts(spark, source, target, point, "parquet")
    again.awaitTermination()
    assert state(spark, target) == before and sum(p["numInputRows"] for p in again.recentProgress) == 0
    with pytest.raises(Exception, match="(?i)path"):
        live_counts(spark, f"file://{tmp_path}/none").collect()
