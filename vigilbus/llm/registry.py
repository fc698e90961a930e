"""Registry of this subpackage's queries, apart from the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilbus.queries.registry import Query

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the equivalent statement."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
