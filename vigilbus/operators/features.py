"""Per-vehicle time-series features with bounded look-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilbus.operators.state import ORDER
from vigilbus.plans.series import (
    TARGET_ROWS, heavy_keys, join_null_safe, rolling, running, small_side, trailing_count,
)
from vigilbus.schema import EDGE_FEATURES

SECOND_US = 1_000_000


def message_rate(frames: DataFrame, keys: Sequence[str], span_us: int = SECOND_US,
                 suspicious: int = 20, attack: int = 50,
                 target_rows: float | None = None) -> DataFrame:
    """Messages of the key in the trailing span, with the two alert levels."""
    counted = trailing_count(frames, keys, "ts", span_us, "rate", target_rows)
    return counted.withColumns({
        "is_suspicious": F.col("rate") > suspicious, "is_attack": F.col("rate") > attack,
    })


def rate_alerts(rated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: peak rate and the first and last time above the suspicious level."""
    hit = F.col("is_suspicious")
    return rated.groupBy(*keys).agg(
        F.max("rate").alias("peak_rate"),
        F.count_if(hit).alias("suspicious_rows"),
        F.count_if(F.col("is_attack")).alias("attack_rows"),
        F.unix_micros(F.min(F.when(hit, F.col("ts")))).alias("first_us"),
        F.unix_micros(F.max(F.when(hit, F.col("ts")))).alias("last_us"),
    ).where("suspicious_rows > 0")


def alert_hold(rated: DataFrame, keys: Sequence[str], hold_us: int = 3 * SECOND_US,
               flag: str = "is_attack", target_rows: float | None = None) -> DataFrame:
    """Alert light: on while the last flagged row of the key is at most ``hold_us`` old."""
    us = F.unix_micros("ts")
    rows = running(rated, keys, ORDER, {"_last": ("last", F.when(F.col(flag), us))}, target_rows)
    return rows.withColumn(
        "alert_on", F.coalesce(us - F.col("_last") <= hold_us, F.lit(False))
    ).drop("_last")


def deltas(df: DataFrame, columns: Sequence[str], key: str = "vehicle_id",
           target_rows: float | None = None) -> DataFrame:
    """``<c>_delta``: change from the previous row, missing values as 0, first row 0."""
    def build(w, index):
        return {
            f"{c}_delta": F.coalesce(
                F.coalesce(F.col(c), F.lit(0.0)) - F.lag(F.coalesce(F.col(c), F.lit(0.0))).over(w),
                F.lit(0.0),
            )
            for c in columns
        }

    return rolling(df, [key], ORDER, 1, build, target_rows)


def signal_statistics(df: DataFrame, columns: Sequence[str], width: int,
                      key: str = "vehicle_id", target_rows: float | None = None) -> DataFrame:
    """Value, delta, rolling mean and rolling population deviation over the last ``width`` rows."""
    def build(w, index):
        frame = w.rowsBetween(-(width - 1), 0)
        out = {}
        for c in columns:
            out[f"{c}_delta"] = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
            out[f"{c}_mean"] = F.avg(c).over(frame)
            out[f"{c}_std"] = F.coalesce(F.stddev_pop(c).over(frame), F.lit(0.0))
        return out

    return rolling(df, [key], ORDER, max(width - 1, 1), build, target_rows)


def row_rate(df: DataFrame, rows: int = 100, key: str = "vehicle_id",
             target_rows: float | None = None) -> DataFrame:
    """``message_frequency``: rows per second over the last ``rows`` rows; 1.0 for the first."""
    us = F.unix_micros("ts")

    def build(w, index):
        frame = w.rowsBetween(-(rows - 1), 0)
        n = F.count(F.lit(1)).over(frame)
        span = (us - F.min(us).over(frame)) / float(SECOND_US)
        rate = F.when(n == 1, 1.0).when(span > 0, n / span).otherwise(n.cast("double"))
        return {"message_frequency": rate}

    return rolling(df, [key], ORDER, rows - 1, build, target_rows)


def inter_arrival(df: DataFrame, default_s: float = 0.1, key: str = "vehicle_id",
                  target_rows: float | None = None) -> DataFrame:
    us = F.unix_micros("ts")
    return rolling(
        df, [key], ORDER, 1,
        lambda w, i: {"inter_arrival_time": F.coalesce(
            (us - F.lag(us).over(w)) / float(SECOND_US), F.lit(default_s))},
        target_rows,
    )


def dispersion(df: DataFrame, column: str = "speed_kmh", rows: int = 10, key: str = "vehicle_id",
               target_rows: float | None = None) -> DataFrame:
    """``payload_entropy``: capped deviation/mean ratio of the last ``rows`` values, 0 before."""
    def build(w, index):
        frame = w.rowsBetween(-(rows - 1), 0)
        full = F.count(F.lit(1)).over(frame) == rows
        std = F.stddev_pop(column).over(frame)
        ratio = F.least(F.lit(1.0), std / (F.avg(column).over(frame) + 1e-8))
        return {"payload_entropy": F.when(full & (std > 0), ratio).otherwise(0.0)}

    return rolling(df, [key], ORDER, rows - 1, build, target_rows)


def throttle_brake(throttle: Column, brake: Column) -> Column:
    return F.when(throttle + brake > 0, throttle * brake / 100).otherwise(0.0)


def edge_features(state: DataFrame, key: str = "vehicle_id",
                  target_rows: float | None = None) -> DataFrame:
    """All derived features in one pass over one ordering, then the 25-wide vector.

    Columns the input lacks enter the vector as 0.
    """
    us = F.unix_micros("ts")
    speed = F.coalesce(F.col("speed_kmh"), F.lit(0.0))

    def build(w, index):
        hundred, ten = w.rowsBetween(-99, 0), w.rowsBetween(-9, 0)
        n = F.count(F.lit(1)).over(hundred)
        span = (us - F.min(us).over(hundred)) / float(SECOND_US)
        std = F.stddev_pop(speed).over(ten)
        ratio = F.least(F.lit(1.0), std / (F.avg(speed).over(ten) + 1e-8))
        full = F.count(F.lit(1)).over(ten) == 10
        return {
            "speed_delta": F.coalesce(speed - F.lag(speed).over(w), F.lit(0.0)),
            "message_frequency": F.when(n == 1, 1.0).when(span > 0, n / span)
            .otherwise(n.cast("double")),
            "inter_arrival_time": F.coalesce(
                (us - F.lag(us).over(w)) / float(SECOND_US), F.lit(0.1)),
            "payload_entropy": F.when(full & (std > 0), ratio).otherwise(0.0),
        }

    rows = rolling(state, [key], ORDER, 99, build, target_rows).withColumn(
        "throttle_brake_ratio",
        throttle_brake(F.coalesce(F.col("throttle"), F.lit(0.0)),
                       F.coalesce(F.col("brake"), F.lit(0.0))),
    )
    return rows.withColumn("features", feature_vector(rows.columns, EDGE_FEATURES))


def feature_vector(available: Sequence[str], names: Sequence[str]) -> Column:
    """Ordered feature array; absent columns and nulls become 0."""
    known = set(available)
    return F.array(*[
        F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in known else F.lit(0.0)
        for n in names
    ])


def newest_rows(df: DataFrame, keep: int, keys: Sequence[str] = ("vehicle_id",),
                slots: int = 64, target_rows: float | None = None) -> DataFrame:
    """The newest ``keep`` rows per key, with ``recency`` 1 for the newest.

    Heavy keys are first cut, before any shuffle, to the hours that hold their newest ``keep``
    rows; the cut-off hours come from counts. Then rows are cut to ``keep`` per (key, slot), so
    the last ordering of one key sees at most ``slots * keep`` rows.
    """
    keys = list(keys)
    heavy = heavy_keys(df, keys, max(target_rows or TARGET_ROWS, keep))
    rows = df if heavy is None else _newest_hours(df, heavy.select(*keys), keep, keys)
    backwards = [F.col("ts").desc(), F.col("seq").desc()]
    first = Window.partitionBy(*keys, "_slot").orderBy(*backwards)
    last = Window.partitionBy(*keys).orderBy(*backwards)
    return (
        rows.withColumn("_slot", F.pmod(F.xxhash64("seq"), F.lit(slots)))
        .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= keep)
        .withColumn("recency", F.row_number().over(last)).where(F.col("recency") <= keep)
        .drop("_slot", "_rn")
    )


def _newest_hours(df: DataFrame, heavy: DataFrame, keep: int, keys: Sequence[str]) -> DataFrame:
    rows = df.withColumn("_hour", F.expr("unix_micros(ts) div 3600000000"))
    counts = join_null_safe(rows.select(*keys, "_hour"), heavy, keys, "left_semi").groupBy(
        *keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    newest_first = Window.partitionBy(*keys).orderBy(F.col("_hour").desc())
    reached = F.sum("_n").over(newest_first.rowsBetween(Window.unboundedPreceding, 0)) >= keep
    cutoff = counts.select(*keys, "_hour", reached.alias("_reached")).where("_reached").groupBy(
        *keys).agg(F.max("_hour").alias("_cutoff"))
    joined = join_null_safe(rows, small_side(cutoff), keys, "left")
    recent = F.col("_cutoff").isNull() | (F.col("_hour") >= F.col("_cutoff"))
    return joined.where(recent).drop("_hour", "_cutoff")


def changed_rows(df: DataFrame, columns: Sequence[str], key: str = "vehicle_id",
                 target_rows: float | None = None) -> DataFrame:
    """Rows where any column differs from the row before; the first row of a key counts.

    Rows that are left out equal the last one kept, so comparing neighbours is enough.
    """
    now = F.struct(*columns)
    return rolling(
        df, [key], ORDER, 1,
        lambda w, i: {"_changed": (i == 1) | ~now.eqNullSafe(F.lag(now).over(w))}, target_rows,
    ).where("_changed").drop("_changed")


def charge_estimate(df: DataFrame, start: float = 100.0, rate: float = 0.1,
                    key: str = "vehicle_id", target_rows: float | None = None) -> DataFrame:
    """Charge left after using ``throttle * rate`` per row, never below 0 (throttle >= 0)."""
    rows = running(df, [key], ORDER, {"_used": ("sum", F.col("throttle") * rate)}, target_rows)
    return rows.withColumn(
        "charge", F.greatest(F.lit(0.0), F.lit(start) - F.coalesce(F.col("_used"), F.lit(0.0)))
    ).drop("_used")


def speed_kmh(vx: Column, vy: Column, vz: Column | None = None) -> Column:
    squared = vx * vx + vy * vy if vz is None else vx * vx + vy * vy + vz * vz
    return 3.6 * F.sqrt(squared)
