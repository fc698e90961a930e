"""Fixed-length windows over a vehicle's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.functions import noise
from vigilbus.operators.features import feature_vector, newest_rows
from vigilbus.operators.state import ORDER
from vigilbus.plans.series import positions, rolling
from vigilbus.schema import WINDOW_FEATURES, WINDOW_LENGTH

OUT = ["start_seq", "end_seq", "start_us", "end_us", "number", "w"]


def _collect(df: DataFrame, features: Sequence[str], length: int, stride: int, ahead: int,
             key: str, label: str | None, target_rows: float | None) -> DataFrame:
    vector = feature_vector(df.columns, features)
    rows = df.select(key, "ts", "seq", vector.alias("_v"), *([label] if label else []))

    def build(w, index):
        frame = w.rowsBetween(-(length - 1 + ahead), -ahead)
        out = {
            "_at": index - length - ahead,
            "start_seq": F.first("seq").over(frame), "end_seq": F.last("seq").over(frame),
            "start_us": F.unix_micros(F.first("ts").over(frame)),
            "end_us": F.unix_micros(F.last("ts").over(frame)),
            "w": F.collect_list("_v").over(frame),
        }
        if label:
            out["label"] = F.max(F.col(label).cast("int")).over(frame)
        return out

    out = rolling(rows, [key], ORDER, length - 1 + ahead, build, target_rows)
    at = F.col("_at")
    return out.where((at >= 0) & (at % stride == 0)).select(
        key, "start_seq", "end_seq", "start_us", "end_us",
        (F.floor(at / stride) + 1).alias("number"), "w", *(["label"] if label else []))


def sliding(df: DataFrame, features: Sequence[str] = WINDOW_FEATURES, length: int = WINDOW_LENGTH,
            stride: int = 1, key: str = "vehicle_id", label: str | None = None,
            target_rows: float | None = None) -> DataFrame:
    """Every window of ``length`` consecutive rows starting at a multiple of ``stride``.

    ``label`` names a 0/1 or boolean column; a window is 1 if any of its rows is.
    """
    return _collect(df, features, length, stride, 0, key, label, target_rows)


def training(df: DataFrame, features: Sequence[str] = WINDOW_FEATURES,
             length: int = WINDOW_LENGTH, stride: int = 20, cap: int | None = None,
             key: str = "vehicle_id", target_rows: float | None = None) -> DataFrame:
    """Training windows, each followed by at least one row; the first ``cap`` of a vehicle if given."""
    rows = _collect(df, features, length, stride, 1, key, None, target_rows)
    return rows if cap is None else rows.where(F.col("number") <= cap)


def padded_short(df: DataFrame, features: Sequence[str] = WINDOW_FEATURES,
                 length: int = WINDOW_LENGTH, padding: str = "zero",
                 key: str | Sequence[str] = "vehicle_id") -> DataFrame:
    """One window per vehicle (or other key) with fewer than ``length`` rows, padded in front.

    Vehicles are counted first, so only groups below ``length`` rows are gathered.
    """
    keys = [key] if isinstance(key, str) else list(key)
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < length)
    rows = df.join(short.select(*keys), keys, "left_semi").select(
        *keys, F.struct("ts", "seq", feature_vector(df.columns, features).alias("v")).alias("_r"))
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_s"))
    vectors = F.transform("_s", lambda r: r["v"])
    blank = F.array(*[F.lit(0.0)] * len(features)) if padding == "zero" else F.get(vectors, F.lit(0))
    return gathered.select(
        *keys, F.size("_s").alias("rows"),
        F.concat(F.array_repeat(blank, F.lit(length) - F.size("_s")), vectors).alias("w"))


def latest(df: DataFrame, features: Sequence[str] = WINDOW_FEATURES,
           length: int = WINDOW_LENGTH, key: str = "vehicle_id") -> DataFrame:
    """The newest window per vehicle; ``w`` is null with fewer than ``length`` rows."""
    newest = newest_rows(df, length, [key]).select(
        key, F.struct("ts", "seq", feature_vector(df.columns, features).alias("v")).alias("_r"))
    gathered = newest.groupBy(key).agg(F.sort_array(F.collect_list("_r")).alias("_s"))
    vectors = F.transform("_s", lambda r: r["v"])
    return gathered.select(
        key, F.element_at("_s", -1)["seq"].alias("end_seq"), F.size("_s").alias("rows"),
        F.when(F.size("_s") == length, vectors).alias("w"))


def flat(w: Column) -> Column:
    return F.flatten(w)


def unflat(v: Column, features: int = len(WINDOW_FEATURES), length: int = WINDOW_LENGTH) -> Column:
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    return F.transform(steps, lambda i: F.slice(v, i * features + 1, F.lit(features)))


def explain(windows: DataFrame, fitted: Mapping[str, tuple[float, float]],
            features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per window step: normalised and original value of every feature."""
    rows = windows.select(*keep, F.posexplode("w").alias("step", "_v"))
    columns = []
    for i, name in enumerate(features):
        offset, scale = fitted[name]
        z = F.col("_v")[i]
        columns += [z.alias(f"{name}_z"), (z * scale + offset).alias(name)]
    return rows.select(*keep, "step", *columns)


def uniform_sample(df: DataFrame, k: int, order: Sequence[str],
                   target_rows: float | None = None) -> DataFrame:
    """k rows spread evenly over the whole order, first and last included.

    Row p (from 0) is taken if p = floor(i (n-1) / (k-1)) for some i < k.
    """
    n = df.count()
    if n <= k:
        return df
    if k == 1:
        return df.orderBy(*order).limit(1)
    numbered = positions(df, [], order, "_p", target_rows)
    p = F.col("_p") - 1
    i = F.expr(f"((_p - 1) * {k - 1} + {n - 2}) div {n - 1}")
    return numbered.where((i < k) & (F.floor(i * (n - 1) / (k - 1)) == p)).drop("_p")


def sequential_split(df: DataFrame, ratio: float, order: Sequence[str],
                     target_rows: float | None = None) -> DataFrame:
    """``is_train``: the first floor(n * ratio) rows of the whole order."""
    cut = int(df.count() * ratio)
    return positions(df, [], order, "_p", target_rows).withColumn(
        "is_train", F.col("_p") <= cut).drop("_p")


def shuffled(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Seeded random order."""
    return df.withColumn("draw", noise.digest(seed, *keys)).orderBy("draw", *keys)


def batches(df: DataFrame, seed: int, keys: Sequence[str], size: int,
            target_rows: float | None = None) -> DataFrame:
    """Batch number of each row in a seeded random order."""
    drawn = df.withColumn("_d", noise.digest(seed, *keys))
    numbered = positions(drawn, [], ["_d", *keys], "_p", target_rows)
    return numbered.withColumn("batch", F.expr(f"(_p - 1) div {size}")).drop("_d", "_p")


def random_sample(df: DataFrame, k: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """k rows in seeded order (a top-k, so no full sort)."""
    return df.withColumn("_d", noise.digest(seed, *keys)).orderBy("_d", *keys).limit(k).drop("_d")
