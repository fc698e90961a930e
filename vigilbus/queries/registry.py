"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the equivalent statement."""

    def register(fn: Callable) -> Callable:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql)
        return fn

    return register


def with_sql(*parts: str) -> str:
    """``WITH a, b, c SELECT ...``: all parts but the last are common table expressions."""
    return "WITH " + ", ".join(parts[:-1]) + "\n" + parts[-1]
