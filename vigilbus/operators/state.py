"""Last-known state: as-of merges written as running last values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.plans.series import rolling, running
from vigilbus.schema import STATE_DEFAULTS

ORDER = ["ts", "seq"]
GRID_CHUNK = 10_000


def assemble_state(signals: DataFrame, defaults: Mapping[str, float] | None = None,
                   keep: Sequence[str] = (), key: str = "vehicle_id",
                   target_rows: float | None = None) -> DataFrame:
    """One row per signal sample holding the last known value of every signal."""
    defaults = dict(STATE_DEFAULTS if defaults is None else defaults)
    values = {
        s: ("last", F.when(F.col("signal") == s, F.col("value"))) for s in defaults
    }
    rows = running(signals, [key], ORDER, values, target_rows)
    filled = [F.coalesce(F.col(s), F.lit(float(d))).alias(s) for s, d in defaults.items()]
    return rows.select("ts", key, "seq", *keep, *filled)


def asof_merge(left: DataFrame, right: DataFrame, columns: Sequence[str],
               key: str = "vehicle_id", defaults: Mapping[str, float] | None = None,
               target_rows: float | None = None) -> DataFrame:
    """Attach to each left row the latest right values at or before it.

    Both sides carry (key, ts, seq). At equal times a right row counts as earlier.
    """
    defaults = defaults or {}
    tagged_left = left.withColumn("_side", F.lit(1))
    tagged_right = right.select(
        key, "ts", "seq", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(0).alias("_side")
    )
    both = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
    filled = running(
        both, [key], ["ts", "_side", "seq"],
        {c: ("last", F.col(f"_{c}")) for c in columns}, target_rows,
    )
    kept = filled.where(F.col("_side") == 1).drop("_side", *[f"_{c}" for c in columns])
    for name, value in defaults.items():
        kept = kept.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return kept


def label_by_intervals(rows: DataFrame, log: DataFrame, key: str = "vehicle_id",
                       target_rows: float | None = None) -> DataFrame:
    """Mark rows with start <= ts < end for any logged interval of the key.

    Among the intervals that have started, the one reaching furthest decides; a row is inside
    some interval exactly if it is inside that one. No row-interval pairs are formed.
    """
    starts = log.select(
        key, F.col("start_time").alias("ts"),
        F.struct("end_time", "attack_type").alias("_reach"),
    )
    both = rows.withColumns({"_side": F.lit(1)}).unionByName(
        starts.withColumns({"_side": F.lit(0), "seq": F.lit(-1).cast("long")}),
        allowMissingColumns=True,
    )
    swept = running(both, [key], ["ts", "_side", "seq"], {"_far": ("max", F.col("_reach"))},
                    target_rows)
    inside = F.coalesce(F.col("_far.end_time") > F.col("ts"), F.lit(False))
    return swept.where(F.col("_side") == 1).withColumns({
        "in_attack": inside,
        "attack_type": F.when(inside, F.col("_far.attack_type")),
    }).drop("_side", "_far", "_reach")


def sample_grid(state: DataFrame, columns: Sequence[str], step_us: int, key: str = "vehicle_id",
                target_rows: float | None = None, until_us: Column | None = None) -> DataFrame:
    """State at every multiple of ``step_us`` from the first to the last row of the key.

    With ``until_us`` the last state of a key goes on up to that time, which is not included. Each row expands to the grid points before its successor, so no per-key grid is built.
    """
    us = F.unix_micros("ts")
    backwards = [F.col("ts").desc(), F.col("seq").desc()]
    rows = rolling(
        state, [key], backwards, 1, lambda w, i: {"_until": F.lag(us, 1).over(w) - 1}, target_rows
    )
    # Two steps, so that a long silence never becomes one huge array.
    first = F.ceil(us / step_us).cast("long")
    end = us if until_us is None else until_us - 1
    last = F.floor(F.coalesce(F.col("_until"), end) / step_us).cast("long")
    spans = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last").select(
        key, *columns, "_first", "_last",
        F.explode(F.sequence(F.floor(F.col("_first") / GRID_CHUNK),
                             F.floor(F.col("_last") / GRID_CHUNK))).alias("_chunk"),
    )
    low = F.greatest("_first", F.col("_chunk") * GRID_CHUNK)
    high = F.least("_last", F.col("_chunk") * GRID_CHUNK + GRID_CHUNK - 1)
    points = spans.select(key, *columns, F.explode(F.sequence(low, high)).alias("_point"))
    return points.select(key, (F.col("_point") * step_us).alias("grid_us"), *columns)
