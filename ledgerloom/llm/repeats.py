"""Numbers within equal rows, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .store import written

#: monotonically_increasing_id counts rows from 0 in the lower bits and holds the task in the upper ones.
TASK_BITS = 33


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once, with copy: 0, 1, 2, ... within the rows of equal key (a long column key that rows has).

    Keys are counted with partial sums. Only rows of keys that occur twice go further: they are counted by the task
    that wrote them, and each gets the copies of earlier tasks plus its place in its own. So a key that holds a third
    of all rows is numbered by as many tasks as wrote it. Which of the rows of a key gets which number is left open.
    """
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), name)
    again = written(rows.groupBy("key").count().where("count > 1").select("key"), "again")
    repeated = rows.join(again, "key", "left_semi").withColumn("task", F.shiftrightunsigned("row", TASK_BITS))
    before = F.sum("own").over(W.partitionBy("key").orderBy("task")) - F.col("own")
    counts = repeated.groupBy("key", "task").agg(F.count("*").alias("own")).select("key", "task", before.alias("before"))
    place = repeated.withColumn("place", F.row_number().over(W.partitionBy("key", "task").orderBy("row")) - 1)
    copies = place.join(counts, ["key", "task"]).select(*rows.columns, (F.col("before") + F.col("place")).alias("copy"))
    once = rows.join(again, "key", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("copy"))
    return written(once.unionByName(copies).drop("row"), name)
