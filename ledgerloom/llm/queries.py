"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encoded, token_digests
from .centroids import CENTROID_SQL, centroid_clusters
from .decontamination import leaks
from .embeddings import embedding_components
from .language import fit_language, languages
from .lines import line_decisions
from .mixing import mix_sources
from .ngram_join import ngram_components
from .quality import fit_quality, quality_scores
from .runs import document_runs, run_digests, with_planted_repeats
from .sampling import fold
from .secrets import fit_ratios, secret_digests, secret_spans
from .sharding import kd_shards
from .surrogates import with_surrogates
from .twins import EMBEDDING_SQL, NGRAM_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))[0]


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True))
    return languages(docs, fit_language(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(_table(spark, sf_dir, "documents"), "registered query")


def op6_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_digests(secret_spans(docs, fit_ratios(docs)))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(_table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(_table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(document_runs(with_planted_repeats(_table(spark, sf_dir, "documents"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_network": op2_quality_network,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_language_codes": op4_language_codes,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_secret_markov": op6_secret_markov,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_kd_shards": op8_kd_shards,
    "op9_embedding_pq": op9_embedding_pq,
    "op10_template_leaks": op10_template_leaks,
    "op11_centroids": op11_centroids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": NGRAM_SQL, "op9_embedding_pq": EMBEDDING_SQL, "op11_centroids": CENTROID_SQL}
