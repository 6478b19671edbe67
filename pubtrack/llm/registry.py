"""Registry of the queries of this subpackage, apart from that of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, directory)`` under ``name``, with equivalent SQL where there is any."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{directory}/documents.parquet")
