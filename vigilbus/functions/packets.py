"""Columns of nested signal packets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilbus.schema import PACKET_SIGNALS

PACKET_COLUMNS = list(PACKET_SIGNALS.values())


def rounded(column: Column, dtype: T.DataType, digits: int) -> Column:
    """The same value with every double in it rounded, at any depth."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(column, digits)
    if isinstance(dtype, T.StructType):
        out = column
        for field in dtype.fields:
            out = out.withField(field.name, rounded(column[field.name], field.dataType, digits))
        return out
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: rounded(x, dtype.elementType, digits))
    return column


def any_attacked(names: Sequence[str] = PACKET_COLUMNS) -> Column:
    """True if any signal of the packet is marked."""
    marks = [F.coalesce(F.col(f"{n}.attacked") == "yes", F.lit(False)) for n in names]
    return reduce(lambda a, b: a | b, marks)


def attacked_signals(names: Sequence[str] = PACKET_COLUMNS) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col(f"{n}.attacked") == "yes", F.lit(n)) for n in names
    ]))


def signal_value(name: str) -> Column:
    """Nested value, else the legacy scalar, else 0."""
    return F.coalesce(F.col(f"{name}.value"), F.col(f"{name}_scalar"), F.lit(0.0))


def bus_time(names: Sequence[str] = PACKET_COLUMNS) -> Column:
    """Time of the first signal with value and time; else any time; else reception time."""
    full = [F.when(F.col(f"{n}.value").isNotNull(), F.col(f"{n}.raw_timestamp")) for n in names]
    bare = [F.col(f"{n}.raw_timestamp") for n in names]
    return F.coalesce(*full, *bare, F.col("reception_us") / 1e6)


def without_raw_times(names: Sequence[str] = PACKET_COLUMNS) -> dict[str, Column]:
    return {n: F.col(n).dropFields("raw_timestamp") for n in names}


def published(kinds: dict[str, T.DataType]) -> Column:
    """Packet as JSON text: signal names as sent, raw times dropped, values to 4 and positions
    to 2 decimals. ``kinds`` are the column types of the packet."""
    signals = [
        rounded(F.col(column), kinds[column], 4).dropFields("raw_timestamp").alias(name)
        for name, column in PACKET_SIGNALS.items()
    ]
    place = rounded(F.col("location"), kinds["location"], 2).alias("Location")
    return F.to_json(F.struct(*signals, place))
