"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds; null where doc_id is."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def hash_sample(rows: DataFrame, doc_id: str, at_most: int) -> DataFrame:
    """At most at_most rows, the same ones in every run: those whose hashed doc_id lies below a cut that the count sets."""
    n = rows.count()
    if n <= at_most:
        return rows
    scale = 1 << 40
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), doc_id), F.lit(scale)) < int(scale * 0.97 * at_most / n)).limit(at_most)


def texts_of(sample: DataFrame, max_chars: int) -> pa.Table:
    """The sample on the driver, without texts over max_chars (for fitting only), ordered by doc_id and text."""
    return sample.where(F.length("text") <= max_chars).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
