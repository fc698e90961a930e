"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_long(digest: Column, start: int, digits: int) -> Column:
    """``digits`` (15 at most) hex digits of a digest from 1-based ``start``, as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; one for a null text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def boxed(df: DataFrame, *needed: str) -> DataFrame:
    """All columns of ``df`` in one struct ``_row``, and the needed ones beside it.

    Operators may add columns of any name to it; ``unboxed`` gives the columns of ``df`` back.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(whole, *[F.col(c).alias(c) for c in dict.fromkeys(needed)])


def unboxed(df: DataFrame, *more: str) -> DataFrame:
    return df.select("_row.*", *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where a lambda of ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
