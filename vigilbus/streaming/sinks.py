"""Streaming sinks: exactly-once file sinks, alerts and status events."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vigilbus.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """New folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
             partition_by: Sequence[str] = (), every: str | None = None) -> StreamingQuery:
    """Append to files. ``every`` is a processing-time interval; by default all data available
    now is processed and the query ends."""
    writer = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode(
        "append")
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def finish(stream: DataFrame, name: str, fmt: str = "parquet",
           partition_by: Sequence[str] = ()) -> DataFrame:
    """Run over all data available now, then read the written files back."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    to_files(stream, path, f"{path}-state", fmt, partition_by).awaitTermination()
    fields = sorted(stream.schema.fields, key=lambda f: f.name in partition_by)
    reader = spark.read.schema(T.StructType(fields))
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def finish_newest(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Drain an aggregating stream, windows still open at its end included.

    Every micro-batch writes the rows it changed under its number, so a repeated batch overwrites
    its own output; the newest row of each key counts.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(handle).outputMode("update").option(
        "checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    stored = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(stored).parquet(path)
    newest = F.max_by(F.struct(*rest), "batch")
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def folder(key: str, folders: int = 64) -> Column:
    """Folder number of a key such as the vehicle: their number does not grow with the fleet."""
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def telemetry_csv(flat: DataFrame, flush_s: int = 600) -> DataFrame:
    """Flat rows with the folder columns of the CSV store: day and flush interval."""
    start = F.window("ts", f"{flush_s} seconds")["start"]
    return flat.withColumns({
        "date": F.date_format(start, "yyyy-MM-dd"), "interval_start": F.unix_seconds(start)})


def alerts(scored: DataFrame, client: str = "vehicle_id", score: str = "score",
           threshold: float | None = None) -> DataFrame:
    """One JSON text per row above its threshold."""
    limit = F.col("threshold") if threshold is None else F.lit(threshold)
    rows = scored.where(F.coalesce(F.col(score) > limit, F.lit(False)))
    body = F.struct(F.col(client).alias("client_id"), F.col(score).alias("score"),
                    limit.alias("threshold"), "round", "timestamp")
    return rows.select(F.to_json(body).alias("value"))


def status_events(cycles: DataFrame) -> DataFrame:
    """Status event rows in the shape clients report."""
    return cycles.select("client_id", "status", "phase", "round", "loss", "timestamp")


def capture_lines(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """One text line per row: time, then the row as JSON."""
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    body = F.to_json(F.struct(*[c for c in stream.columns if c != ts]))
    return stream.select(F.concat_ws(" - ", stamp, body).alias("value"))
