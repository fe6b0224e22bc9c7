"""Registered queries of the library's own operators: each runs an operator over the inputs and may have a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def demo(sql: str | None = None) -> Callable:
    """Register a function of Inputs under its name; sql is its twin over the same tables and derived views."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Inputs(spark, folder))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add
