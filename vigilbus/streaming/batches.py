"""Stateful streams as one batch plan per micro-batch, with the state in a table.

A keyed stream operator puts all rows of a key in one task. Here a micro-batch is a table that is
joined with the state of the last one and goes through the batch operators, which cut a busy
vehicle's rows into blocks with a halo or a carried summary (``plans/series.py``). The rows that the
next micro-batch needs are written as its state.

State is written to one of three folders by batch number and output under the batch number, so a
batch that runs again reads the same state and overwrites its own output. State holds a bounded
number of rows per key; keys that have been silent for ``keep_s`` of event time lose theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilbus.operators import features, state, windows
from vigilbus.plans.series import small_side

SLOTS = 3
#: (rows of the batch, rows of the state) -> (output, rows of the next state)
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def follow(stream: DataFrame, step: Step, folder: str, initial: DataFrame | None = None,
           keep_s: float | None = None) -> StreamingQuery:
    """Run ``step`` on every micro-batch; state rows have the stream's columns, ``us`` among them."""
    return follow_each(stream, lambda spark, number: step, folder, initial, keep_s)


def follow_each(stream: DataFrame, choose: Callable[[SparkSession, int], Step], folder: str,
                initial: DataFrame | None = None, keep_s: float | None = None) -> StreamingQuery:
    """``follow`` with a step that ``choose`` makes for each batch number, alike if the batch runs again."""
    schema = stream.schema

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            held = spark.read.schema(schema).parquet(f"{folder}/state/{(number - 1) % SLOTS}")
        else:
            held = spark.createDataFrame([], schema) if initial is None else initial.select(*schema.names)
        rows = batch.persist()
        try:
            out, after = choose(spark, number)(rows, held)
            out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            if keep_s is not None:
                newest = after.agg(F.max("us")).first()[0] or 0
                after = after.where(F.col("us") >= newest - int(keep_s * 1e6))
            after.select(*schema.names).write.mode("overwrite").parquet(
                f"{folder}/state/{number % SLOTS}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that the batches gave."""
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("batch")


def _last(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of each key's last row."""
    return small_side(held.groupBy(*keys).agg(F.max(F.struct("us", "seq")).alias("_last")))


def _fresh(rows: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State rows and, behind them, the rows of the batch that are not late; ``_old`` marks the first."""
    new = rows.join(_last(held, keys), list(keys), "left").where(
        F.col("_last").isNull() | (F.struct("us", "seq") > F.col("_last"))).drop("_last")
    return held.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))


def changed_state(defaults: Mapping[str, float], target_rows: float | None = None) -> Step:
    """Last-known state wherever it changes; state: the newest row of each signal.

    Rows: ts, us, vehicle_id, seq, signal, value.
    """
    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = _fresh(rows, held, ["vehicle_id"])
        wide = state.assemble_state(both, defaults, keep=["_old"], target_rows=target_rows)
        out = features.changed_rows(wide, list(defaults), target_rows=target_rows).where("NOT _old")
        newest = F.max_by(F.struct("ts", "us", "seq", "value"), F.struct("us", "seq"))
        after = both.groupBy("vehicle_id", "signal").agg(newest.alias("_r")).select(
            "vehicle_id", "signal", "_r.*")
        return out.drop("_old", "ts"), after

    return step


def online_windows(columns: Sequence[str], length: int = 20, target_rows: float | None = None) -> Step:
    """Every window of ``length`` rows as it completes; state: the last length-1 rows of a vehicle.

    Rows: ts, us, vehicle_id, seq and the columns.
    """
    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = _fresh(rows, held, ["vehicle_id"]).drop("_old")
        done = windows.sliding(both, columns, length, target_rows=target_rows)
        out = done.join(_last(held, ["vehicle_id"]), "vehicle_id", "left").where(
            F.col("_last").isNull() | (F.struct(F.col("end_us").alias("us"), F.col("end_seq").alias(
                "seq")) > F.col("_last"))).select("vehicle_id", "end_seq", F.flatten("w").alias("flat"))
        return out, features.newest_rows(both, length - 1)

    return step


def exact_rate(span_us: int, keys: Sequence[str] = ("vehicle_id", "signal"),
               target_rows: float | None = None) -> Step:
    """Messages of the key in the trailing span; state: the rows of a key's last span.

    Rows: ts, us, seq and the keys.
    """
    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = held.withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
        rated = features.message_rate(both, keys, span_us, target_rows=target_rows)
        ends = small_side(both.groupBy(*keys).agg(F.max("us").alias("_end")))
        after = both.join(ends, list(keys)).where(F.col("us") > F.col("_end") - span_us)
        return rated.where("NOT _old").select(*keys, "seq", "rate"), after.drop("_old", "_end")

    return step
