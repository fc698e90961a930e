"""Alarm thresholds that follow new scores, from quantile sketches kept per key.

A micro-batch makes one KLL sketch per key, partly in each task, so a busy key is never gathered, and
merges it into the key's sketch from the last micro-batch. A sketch of size ``k`` holds a few thousand
numbers however many scores it has seen. ``evaluate.calibrate`` is the exact form over a whole table.

State is written to one of three folders by batch number and thresholds under the batch number, so a
batch that runs again starts from the same state and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vigilbus.operators.evaluate import MIN_ERRORS, PERCENTILE, SAFETY

SLOTS = 3
SKETCH_SIZE = 1024


def rank_error(k: int = SKETCH_SIZE) -> float:
    """Bound, with 99 % confidence, on the error of a quantile's rank as a share of all scores."""
    # Published constants of the KLL sketch.
    return 2.296 / k**0.9021


def follow(scores: DataFrame, folder: str, by: Sequence[str] = ("vehicle_id",), score: str = "score",
           fraction: float = PERCENTILE, factor: float = SAFETY, min_rows: int = MIN_ERRORS,
           k: int = SKETCH_SIZE) -> StreamingQuery:
    """Keep (keys, n, threshold) up to date: quantile * factor, null with ``min_rows`` scores or fewer.

    Null and NaN scores take no part; null keys are a key of their own.
    """
    by = list(by)
    fields = [f for f in scores.schema.fields if f.name in by]
    schema = T.StructType([*fields, T.StructField("sketch", T.BinaryType())])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        value = F.col(score).cast("double")
        new = batch.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(
            F.kll_sketch_agg_double(value, k).alias("sketch")).select(*schema.names)
        if number:
            held = spark.read.schema(schema).parquet(f"{folder}/state/{(number - 1) % SLOTS}")
            new = held.unionByName(new).groupBy(*by).agg(
                F.kll_merge_agg_double("sketch", k).alias("sketch")).select(*schema.names)
        slot = f"{folder}/state/{number % SLOTS}"
        new.write.mode("overwrite").parquet(slot)
        n = F.kll_sketch_get_n_double("sketch")
        at = F.kll_sketch_get_quantile_double("sketch", F.lit(float(fraction)))
        spark.read.schema(schema).parquet(slot).select(
            *by, n.alias("n"), F.when(n > min_rows, at * factor).alias("threshold"),
        ).write.mode("overwrite").parquet(f"{folder}/thresholds/batch={number}")

    return scores.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds after the newest micro-batch."""
    rows = spark.read.parquet(f"{folder}/thresholds")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
