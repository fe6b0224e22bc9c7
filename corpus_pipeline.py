"""Corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, from a table in the shared folder.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontamination import decontaminated
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.ngram_join import one_of_each_group
from ledgerloom.llm.quality import fit_quality, quality_scores
from ledgerloom.llm.sharding import kd_shards
from ledgerloom.llm.store import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted to the labels of docs, gives a probability of 0.5 or more."""
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    return quality_scores(docs, net).where("score >= 0.5").select(*columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    return kd_shards(docs, 24)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: SQL cannot express the network, the template windows or the k-d tree; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
