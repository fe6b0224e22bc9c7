"""Intermediate tables in the folder that driver and executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_shared(df: DataFrame) -> str:
    """Path of df as a Parquet table in the shared folder. The table goes when the driver ends; until then frames may read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialized(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with a short plan, safe from lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df))


def parallel(spark: SparkSession) -> int:
    """Tasks that keep all cores busy."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows of few splits dealt out to all cores: what is done with each takes longer than moving it."""
    return df.repartition(parallel(df.sparkSession))
