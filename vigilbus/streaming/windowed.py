"""Event-time windows, deduplication and round aggregation on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vigilbus.operators import federated as fed


def rate_windows(stream: DataFrame, keys: Sequence[str], span: str, slide: str,
                 delay: str) -> DataFrame:
    """Messages per key in sliding windows; the watermark says when a window is dropped from state."""
    slot = F.window("ts", span, slide)
    return stream.withWatermark("ts", delay).groupBy(slot.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("messages")
    ).select(*keys, F.unix_micros("w.start").alias("start_us"), "messages")


def sampled_state(stream: DataFrame, columns: Sequence[str], step: str, delay: str,
                  key: str = "vehicle_id") -> DataFrame:
    """The last row of the key in each step."""
    newest = F.max_by(F.struct("seq", *columns), F.struct("ts", "seq"))
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", step).alias("w"), key).agg(
        newest.alias("_v")).select(key, F.unix_micros("w.start").alias("start_us"), "_v.*")


def status_summary(stream: DataFrame, every: str, delay: str, flag, key: str = "vehicle_id") -> DataFrame:
    """Rows, flagged rows and value range per interval and vehicle."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).select(key, F.unix_micros("w.start").alias("start_us"), "rows", "flagged", "low", "high")


def sessions(stream: DataFrame, gap: str, delay: str, key: str = "vehicle_id") -> DataFrame:
    """Rows per activity session of the key."""
    return stream.withWatermark("ts", delay).groupBy(
        F.session_window("ts", gap).alias("w"), key
    ).agg(F.count(F.lit(1)).alias("rows")).select(
        key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "rows")


def without_resends(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Each message once, however often a buffered sender repeats it within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def _weighted(rows: DataFrame) -> DataFrame:
    long = rows.select("round", "num_samples", F.posexplode("weights").alias("idx", "value"))
    return long.groupBy("round", "idx").agg(
        F.try_divide(F.sum(F.col("value") * F.col("num_samples")),
                     F.sum("num_samples").cast("double")).alias("value"))


def average_rounds(updates: DataFrame, pending: str, results: str, checkpoint: str,
                   min_clients: int = 2, n_weights: int | None = None) -> StreamingQuery:
    """Average each round once enough clients have sent an update.

    With ``n_weights`` an update of another size, with a missing or infinite weight or without
    samples is rejected before it is stored.

    Updates (client_id, round, update_id, num_samples, loss, weights) wait in a table; a batch
    reads and recomputes only the rounds it has updates for, as the table is partitioned by round. Both tables are written per batch number, so a repeated batch overwrites its own output.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = batch if n_weights is None else batch.where(
            (F.size("weights") == n_weights) & (F.col("num_samples") > 0)
            & F.forall("weights", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
        good.write.mode("overwrite").partitionBy("round").parquet(f"{pending}/batch={number}")
        stored = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        waiting = spark.read.schema(stored).parquet(pending).drop("batch")
        touched = waiting.join(batch.select("round").distinct(), "round", "left_semi")
        newest = fed.latest_updates(touched)
        ready = newest.groupBy("round").agg(F.count(F.lit(1)).alias("_c")).where(
            F.col("_c") >= min_clients)
        averaged = _weighted(newest.join(ready.select("round"), "round", "left_semi"))
        averaged.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return updates.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rounds(spark, results: str) -> DataFrame:
    """The newest average of each round."""
    rows = spark.read.parquet(results)
    newest = rows.groupBy("round").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["round", "batch"], "left_semi").drop("batch")
