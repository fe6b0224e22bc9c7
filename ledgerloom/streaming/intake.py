"""Incremental intake of large objects and running counts by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lobs import identify

FILES = "path string, modificationTime timestamp, length long, content binary"


def _arriving(spark: SparkSession, source: str, fmt: str, files_per_batch: int | None) -> DataFrame:
    files = spark.readStream.format(fmt).schema(FILES)
    files = files.option("recursiveFileLookup", True) if fmt == "binaryFile" else files
    return (files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files).load(source)


def start_intake(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "binaryFile") -> StreamingQuery:
    """Identify each new file once and append it to the inventory at target; a restart goes on from the checkpoint.

    A batch that is run again after a failure replaces its own part of the inventory, so no file is listed twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        identify(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _arriving(spark, source, fmt, None).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def format_counts(stream: DataFrame) -> DataFrame:
    """Files and bytes by extension: the same on a stream, where the sums are kept from batch to batch, and on a table."""
    return stream.groupBy("ext").agg(F.count("*").alias("count"), F.sum("length").alias("bytes"))


def start_counts(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "binaryFile", files_per_batch: int | None = None) -> StreamingQuery:
    """Identify arriving files and keep their counts by extension; what arrived by now is counted, then the query ends.

    The sums live in the state store of the checkpoint, one row for each extension, so a later start goes on from them and
    reads new files only. Of each batch the sums that it changed are written (update mode), under the number of the
    batch: a batch that is run again after a failure replaces its own. Files are identified where they are read; only partial
    sums are shuffled. Without a number of files for each batch, one batch takes all that has arrived.
    """
    counts = format_counts(identify(_arriving(spark, source, fmt, files_per_batch)))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(spark: SparkSession, target: str) -> DataFrame:
    """The counts as they stand: of each extension what the latest batch that changed it wrote, and that batch."""
    written = spark.read.schema("ext string, count long, bytes long, batch long").parquet(target)
    latest = written.groupBy("ext").agg(F.max_by(F.struct("count", "bytes", "batch"), "batch").alias("now"))
    return latest.select("ext", "now.*")
