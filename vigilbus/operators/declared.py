"""Detectors, generators and policies that exist as declared settings, in our own design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.functions import noise
from vigilbus.operators.state import ORDER
from vigilbus.plans.series import rolling, running, settle
from vigilbus.plans.stats import percentiles

SERIES = ["vehicle_id", "signal"]


# Detectors, one per attack type -------------------------------------------------------------

def repeated_sequences(signals: DataFrame, length: int = 5, keys: Sequence[str] = SERIES,
                       target_rows: float | None = None) -> DataFrame:
    """Replay: runs of ``length`` values that occur more than once in a series."""
    def build(w, index):
        run = F.collect_list("value").over(w.rowsBetween(-(length - 1), 0))
        return {"_run": F.when(index >= length, F.md5(F.concat_ws(
            ",", F.transform(run, lambda x: x.cast("decimal(20,4)").cast("string")))))}

    runs = rolling(signals, keys, ORDER, length - 1, build, target_rows).where("_run is not null")
    return runs.groupBy(*keys, F.col("_run").alias("run")).agg(
        F.count(F.lit(1)).alias("times"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq")).where("times > 1")


def deviation(signals: DataFrame, width: int = 10, limit: float = 3.0,
              keys: Sequence[str] = SERIES, target_rows: float | None = None) -> DataFrame:
    """Spoofing: distance from the mean of the previous ``width`` values in deviations."""
    def build(w, index):
        before = w.rowsBetween(-width, -1)
        std = F.stddev_pop("value").over(before)
        z = F.try_divide(F.col("value") - F.avg("value").over(before), F.nullif(std, F.lit(0.0)))
        return {"z": F.when(index > width, z)}

    return rolling(signals, keys, ORDER, width, build, target_rows).withColumn(
        "is_deviation", F.coalesce(F.abs("z") > limit, F.lit(False)))


def missing_messages(signals: DataFrame, factor: float = 3.0, keys: Sequence[str] = SERIES,
                     target_rows: float | None = None) -> DataFrame:
    """Suspension: gaps longer than ``factor`` times the median gap of the series."""
    gaps = rolling(
        signals, keys, ORDER, 1,
        lambda w, i: {"gap_us": F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)},
        target_rows).where("gap_us is not null")
    medians = percentiles(gaps, "gap_us", {"median_us": 0.5}, keys, target_rows).drop("n")
    return gaps.join(medians, list(keys)).where(F.col("gap_us") > factor * F.col("median_us"))


def trend(signals: DataFrame, width: int = 10, keys: Sequence[str] = SERIES,
          target_rows: float | None = None) -> DataFrame:
    """Gradual drift: least-squares slope of the last ``width`` values per row step.

    A null value keeps its place and takes no part.
    """
    def build(w, index):
        frame = w.rowsBetween(-(width - 1), 0)
        x, y = index.cast("double"), F.col("value")
        return {"slope": F.when(x >= width, F.regr_slope(y, x).over(frame))}

    return rolling(signals, keys, ORDER, width - 1, build, target_rows)


def bursts(rated: DataFrame, keys: Sequence[str], flag: str = "is_suspicious",
           target_rows: float | None = None) -> DataFrame:
    """Runs of consecutive flagged rows."""
    target_rows = settle(rated, keys, target_rows)
    rows = rolling(rated, keys, ORDER, 1, lambda w, i: {"_start": (
        F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")}, target_rows)
    rows = running(rows, keys, ORDER, {"burst": ("sum", F.col("_start"))}, target_rows)
    return rows.where(F.col(flag)).groupBy(*keys, "burst").agg(
        F.count(F.lit(1)).alias("rows"), F.max("rate").alias("peak_rate"),
        F.unix_micros(F.min("ts")).alias("start_us"), F.unix_micros(F.max("ts")).alias("end_us"))


# Generators ---------------------------------------------------------------------------------

# Declared generator settings.
FLOOD_PER_SECOND = 1000
FUZZ = 0.3
REPLAY_MS = 100
SPOOF = 0.5
DRIFT_STEP = 0.01
BURST_MS = 50
BURST_EVERY_MS = 500
RATIO = 0.2


def _shift(ts: Column, us: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + us)


def _chosen(rate: float, seed: str) -> Column:
    return noise.uniform(seed, "vehicle_id", "seq") < rate


def _copies(rows: DataFrame, copies: int, gap_us: int, kind: str) -> DataFrame:
    sent = rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return sent.withColumns({
        "ts": _shift(F.col("ts"), F.col("_c") * gap_us), "attack": F.lit(kind)}).drop("_c")


def generate(signals: DataFrame, kind: str, signal: str = "speed_kmh", copies: int = 10,
             ratio: float = RATIO, seed: int = 21, target_rows: float | None = None) -> DataFrame:
    """Signals with one declared attack; ``attack`` is null for untouched rows."""
    plain = signals.withColumn("attack", F.lit(None).cast("string"))
    hit = _chosen(ratio, f"{seed}{kind}")
    mark = F.when(hit, F.lit(kind))
    value = F.col("value")
    if kind == "dos_flood":
        return plain.unionByName(
            _copies(signals.where(hit), copies, 1_000_000 // FLOOD_PER_SECOND, kind))
    if kind == "burst_injection":
        inside = F.unix_millis("ts") % BURST_EVERY_MS < BURST_MS
        return plain.unionByName(_copies(signals.where(inside), copies, 1000, kind))
    if kind == "replay":
        return plain.unionByName(_copies(signals.where(hit), 1, REPLAY_MS * 1000, kind))
    if kind == "suspension":
        return plain.where(~hit)
    if kind == "fuzzing":
        fuzzed = _chosen(FUZZ, f"{seed}{kind}")
        draw = noise.uniform(f"{seed}v", "vehicle_id", "seq") * 255
        return plain.withColumns({"value": F.when(fuzzed, draw).otherwise(value),
                                  "attack": F.when(fuzzed, F.lit(kind))})
    if kind == "spoofing":
        draw = (noise.uniform(f"{seed}v", "vehicle_id", "seq") * 2 - 1) * SPOOF
        return plain.withColumns({"value": F.when(hit, value * (1 + draw)).otherwise(value),
                                  "attack": mark})
    if kind == "targeted_id":
        aimed = hit & (F.col("signal") == signal)
        return plain.withColumns({"value": F.when(aimed, value * 2).otherwise(value),
                                  "attack": F.when(aimed, F.lit(kind))})
    if kind == "gradual_drift":
        rows = rolling(plain, SERIES, ORDER, 0, lambda w, i: {"_i": i - 1}, target_rows)
        return rows.withColumns({"value": value * (1 + DRIFT_STEP * F.col("_i")),
                                 "attack": F.when(F.col("_i") > 0, F.lit(kind))}).drop("_i")
    raise ValueError(f"unknown generator {kind!r}")


# Policies -----------------------------------------------------------------------------------

def fill_missing(df: DataFrame, column: str, policy: str = "interpolate", key: str = "vehicle_id",
                 target_rows: float | None = None) -> DataFrame:
    """Nulls of a column by linear interpolation in time, zero, or dropping the row.

    Before the first and after the last known value the nearest one is used.
    """
    if policy == "zero":
        return df.fillna({column: 0.0})
    if policy == "drop":
        return df.where(F.col(column).isNotNull())
    target_rows = settle(df, [key], target_rows)
    us = F.unix_micros("ts")
    point = F.when(F.col(column).isNotNull(), F.struct(us.alias("t"), F.col(column).alias("v")))
    rows = running(df, [key], ORDER, {"_a": ("last", point)}, target_rows)
    rows = rows.withColumns({"_mus": -us, "_mseq": -F.col("seq")})
    rows = running(rows, [key], ["_mus", "_mseq"], {"_b": ("last", point)}, target_rows)
    a, b = F.col("_a"), F.col("_b")
    share = F.try_divide((us - a["t"]).cast("double"), (b["t"] - a["t"]).cast("double"))
    between = a["v"] + (b["v"] - a["v"]) * share
    return rows.withColumn(
        column, F.coalesce(F.col(column), between, a["v"], b["v"])
    ).drop("_a", "_b", "_mus", "_mseq")


def time_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour("ts"), "minute": F.minute("ts")})


def tracked_metrics(scores: DataFrame, threshold: float, rounds: DataFrame,
                    model_bytes: int) -> DataFrame:
    """(metric, value) rows: error and score means, rates, round duration, sizes."""
    hit = F.col("score") > threshold
    quality = scores.agg(
        F.avg("score").alias("anomaly_score"),
        F.avg(F.when(F.col("label") == 1, hit.cast("double"))).alias("detection_rate"),
        F.avg(F.when(F.col("label") == 0, hit.cast("double"))).alias("false_positive_rate"))
    work = rounds.agg(
        F.avg("loss").alias("reconstruction_loss"),
        F.avg("duration_s").cast("double").alias("round_duration"),
        (F.count(F.lit(1)) * float(model_bytes)).alias("communication_overhead"),
        F.lit(float(model_bytes)).alias("model_size_bytes"))
    parts = [p.unpivot([], p.columns, "metric", "value") for p in (quality, work)]
    return parts[0].unionByName(parts[1])
