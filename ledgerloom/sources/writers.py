"""Sinks: rows as XML or Parquet, ledgers as CSV, events as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_rows(df: DataFrame, path: str, fmt: str = "xml") -> None:
    """Rows, without positions, as XML (table/row; null cells stay out) or Parquet."""
    out = df.drop("table_key", "row_pos")
    if fmt == "xml":
        out.write.format("xml").option("rootTag", "table").option("rowTag", "row").option("attributePrefix", "_").save(path)
    else:
        out.write.parquet(path)


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep=";", header=True)


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
