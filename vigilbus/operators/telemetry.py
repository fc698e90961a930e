"""Dashboard queries over stored packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.functions import packets as P
from vigilbus.plans.series import positions

FLUSH_SECONDS = 600


def flatten(packets: DataFrame, names: Sequence[str] = P.PACKET_COLUMNS) -> DataFrame:
    """One flat row per packet with a yes/no attack mark."""
    return packets.select(
        "vehicle_id", "seq", P.bus_time(names).alias("can_time"),
        *[P.signal_value(n).alias(n) for n in names],
        *[F.coalesce(F.col(f"location.{a}"), F.lit(0.0)).alias(f"location_{a}") for a in "xyz"],
        F.when(P.any_attacked(names), "yes").otherwise("no").alias("attacked"),
    )


def latency(packets: DataFrame, slow_us: int = 1_000_000) -> DataFrame:
    """Reception minus bus time in microseconds."""
    rows = packets.withColumn(
        "latency_us", F.col("reception_us") - F.round(P.bus_time() * 1e6).cast("long"))
    return rows.withColumn("is_slow", F.col("latency_us") > slow_us)


def attribute_series(packets: DataFrame, name: str) -> DataFrame:
    return packets.select(
        "vehicle_id", "seq", "ts", P.signal_value(name).alias("value"),
        F.coalesce(F.col(f"{name}.attacked") == "yes", F.lit(False)).alias("attacked"),
    )


def vehicle_path(packets: DataFrame, key: str = "vehicle_id",
                 target_rows: float | None = None) -> DataFrame:
    """Ordered path points, one row each (a path is never gathered into one array)."""
    known = packets.select(
        key, "ts", "seq", F.col("location.x").alias("x"), F.col("location.y").alias("y")
    ).where("x is not null and y is not null")
    return positions(known, [key], ["ts", "seq"], "step", target_rows)


def latest_by_key(df: DataFrame, columns: Sequence[str], key: str = "vehicle_id") -> DataFrame:
    """Values of the newest row per key, as an aggregate combined before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct("ts", "seq"))
    return df.groupBy(key).agg(newest.alias("_v")).select(key, "_v.*")


def affected_signals(packets: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Marked signals of the newest packet per key."""
    marked = packets.withColumn("affected", P.attacked_signals())
    return latest_by_key(marked, ["seq", "affected"], key)


def packet_counters(packets: DataFrame, now_us: int | None = None,
                    flush_s: int = FLUSH_SECONDS) -> DataFrame:
    """Total packets, packets in the open flush interval and seconds to its end.

    Intervals are aligned to the epoch; "now" is the newest reception time unless given.
    """
    width = flush_s * 1_000_000
    slot = F.floor(F.col("reception_us") / width)
    counts = packets.groupBy(slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("reception_us").alias("_now"))
    now = F.max("_now") if now_us is None else F.lit(now_us)
    summary = counts.agg(
        F.sum("_n").alias("total_packets"), now.alias("_now"),
        F.max_by("_n", "_slot").alias("_open"), F.max("_slot").alias("_slot"))
    open_slot = F.floor(F.col("_now") / width)
    return summary.select(
        "total_packets",
        F.when(F.col("_slot") == open_slot, F.col("_open")).otherwise(0).alias("open_packets"),
        ((open_slot + 1) * width - F.col("_now")).alias("flush_in_us"),
    )


def flush_intervals(packets: DataFrame, flush_s: int = FLUSH_SECONDS,
                    key: str = "vehicle_id") -> DataFrame:
    """Packets per flush interval and vehicle."""
    return packets.groupBy(F.window("ts", f"{flush_s} seconds").alias("w"), key).agg(
        F.count(F.lit(1)).alias("packets")
    ).select(key, F.unix_micros("w.start").alias("start_us"), "packets")
