"""Identifiers and timestamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_number(client_id: Column) -> Column:
    """Number after the last underscore of a client id, 1 if there is none."""
    tail = F.element_at(F.split(client_id, "_"), -1)
    return F.coalesce(tail.try_cast("int"), F.lit(1))


def hex_id(arbitration_id: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(arbitration_id)))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
