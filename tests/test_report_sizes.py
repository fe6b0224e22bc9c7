"""Sizes beyond the last unit, in the function and in its query."""

import duckdb
from pyspark.sql import functions as F

from ledgerloom.functions import labels as B
from ledgerloom.plans import demo_text, registry


def test_last_unit(spark, tmp_path):
    df = spark.createDataFrame([(1 << 40,), (3 << 39,), (1023,)], "n long")
    assert [tuple(r) for r in df.select(B.human_size(F.col("n")), B.human_size(F.col("n"), ("KB", "MB", "GB"))).collect()] == [("1.0 TB", "1024.0 GB"), ("1.5 TB", "1536.0 GB"), ("1023 B", "1023 B")]
    spark.createDataFrame([(k, 7000 * k) for k in range(12)], "o_orderkey long, o_custkey long").withColumn("o_totalprice", F.lit(1.5)).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"select o_custkey, grouped, share, size from ({registry.ORACLES['report_numbers']})").fetchall()
    assert demo_text and sorted(want) == sorted(map(tuple, registry.QUERIES["report_numbers"](spark, str(tmp_path)).select("o_custkey", "grouped", "share", "size").collect()))
