"""Feature statistics, scalers and their stored state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_FIT_ROWS = 50
MIN_STD = 1e-6


def feature_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, mean, population std, min and max per feature, one scan, one row per feature."""
    measures = []
    for c in columns:
        x = F.col(c)
        measures.append(F.struct(
            F.lit(c).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("std"), F.min(x).cast("double").alias("min"),
            F.max(x).cast("double").alias("max"),
        ))
    wide = df.groupBy(*by).agg(F.array(*measures).alias("_m"))
    return wide.select(*by, F.inline("_m"))


def zscore_fit(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scaler rows: offset = mean, scale = population std, or 1 for a (near) constant feature."""
    s = feature_stats(df, columns, by)
    return s.withColumns({
        "offset": F.col("mean"), "scale": F.when(F.col("std") > MIN_STD, F.col("std")).otherwise(1.0),
        "kind": F.lit("standard"), "fitted": F.col("n") >= MIN_FIT_ROWS,
    })


def minmax_fit(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scaler rows: offset = min, scale = range, or 1 for a constant feature (which maps to 0)."""
    s = feature_stats(df, columns, by)
    width = F.col("max") - F.col("min")
    return s.withColumns({
        "offset": F.col("min"), "scale": F.when(width > 0, width).otherwise(1.0),
        "kind": F.lit("minmax"), "fitted": F.col("n") > 0,
    })


def save(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def constants(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """(offset, scale) per feature; a fleet-wide scaler has one row per feature."""
    return {r["feature"]: (r["offset"], r["scale"])
            for r in scaler.select("feature", "offset", "scale").collect()}


def apply(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(offset)) / F.lit(scale) for c, (offset, scale) in fitted.items()})


def invert(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: F.col(c) * F.lit(scale) + F.lit(offset) for c, (offset, scale) in fitted.items()})


def apply_by(df: DataFrame, scaler: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scale with a scaler per group (one scaler row per group and feature)."""
    features = scaler.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "feature", F.struct("offset", "scale")))).alias("_s"))
    names = [c for c in df.columns if c not in by]
    joined = df.join(features, list(by))

    def scaled(c: str) -> Column:
        s = F.col("_s")[c]
        x = F.col(c)
        return F.when(s.isNull(), x).otherwise((x - s["offset"]) / s["scale"])

    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    return joined.withColumns({c: scaled(c) for c in names if c in numeric}).drop("_s")
