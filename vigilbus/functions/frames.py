"""Payload decoding as column arithmetic (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _four_bytes(data: Column, endian: str) -> Column:
    if endian == "big":
        return F.substring(data, 1, 4)
    return F.concat(*[F.substring(data, i, 1) for i in (4, 3, 2, 1)])


def word(data: Column, endian: str = "big") -> Column:
    """First four bytes as an unsigned number; null for a shorter payload."""
    number = F.conv(F.hex(_four_bytes(data, endian)), 16, 10).cast("long")
    return F.when(F.length(data) >= 4, number)


def int_of(w: Column) -> Column:
    """Signed number of an unsigned word."""
    return F.when(w >= 2**31, w - 2**32).otherwise(w)


def float_of(w: Column) -> Column:
    """IEEE-754 single precision value of a word.

    Pass a column that already holds the word: the expression uses it several times.
    """
    sign = F.when(w >= 2**31, -1.0).otherwise(1.0)
    exponent = F.shiftright(w, 23).bitwiseAND(255)
    fraction = w.bitwiseAND(2**23 - 1)
    special = F.when(fraction == 0, sign * float("inf")).otherwise(float("nan"))
    tiny = sign * fraction * F.lit(2.0**-149)
    normal = sign * (1 + fraction / float(2**23)) * F.pow(F.lit(2.0), exponent - 127)
    value = F.when(exponent == 255, special).when(exponent == 0, tiny).otherwise(normal)
    return F.when(w.isNotNull(), value)


def int32(data: Column, endian: str = "big") -> Column:
    return int_of(word(data, endian))


def float32(data: Column, endian: str = "big") -> Column:
    return float_of(word(data, endian))


def value_of(w: Column, kind: Column) -> Column:
    return F.when(kind == "i32", int_of(w).cast("double")).otherwise(float_of(w))


def signature_flag(data: Column) -> Column:
    """Top bit of the last byte; false for an empty payload."""
    last = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("int")
    return F.coalesce(last >= 128, F.lit(False))


def _byte(data: Column, position: Column) -> Column:
    return F.conv(F.substring(F.hex(data), position * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _join_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def scale_bytes(data: Column, double: Column) -> Column:
    """Every byte doubled (at most 255) where ``double``, else halved (rounded down)."""
    places = F.sequence(F.lit(0), F.length(data) - 1)
    scaled = F.transform(
        places,
        lambda i: F.when(double, F.least(F.lit(255), _byte(data, i) * 2)).otherwise(
            F.shiftright(_byte(data, i), 1)),
    )
    return F.when(F.length(data) > 0, _join_bytes(scaled)).otherwise(data)


def mark(data: Column) -> Column:
    """Set the signature bit; an empty payload stays empty."""
    size = F.length(data)
    last = _byte(data, size - 1).bitwiseOR(128)
    head = F.substring(data, F.lit(1), size - 1)
    return F.when(size > 0, F.concat(head, F.unhex(F.lpad(F.hex(last), 2, "0")))).otherwise(data)
