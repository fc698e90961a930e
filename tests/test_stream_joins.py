"""Joins of two streams equal the batch joins, whatever order rows arrive in within the delays."""

import pytest
from pyspark.sql import functions as F

from vigilbus.operators import state
from vigilbus.streaming import joins, sinks, sources

START = 1_700_000_000_000_000
FLUSH = START + 7_200_000_000


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def landed(spark, folder, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return sources.files(spark, folder, parts[0].schema, files_per_trigger=1)


def dealt(rows, late):
    """Three parts in order of time, every ``late``-th row one part later, shuffled inside a part."""
    part = F.least(F.expr("n div 100") + F.when(F.col("n") % late == 0, 1).otherwise(0), F.lit(2))
    rows = rows.withColumn("_p", part)
    return [rows.where(f"_p = {i}").drop("_p", "n").orderBy(F.xxhash64("seq")) for i in range(3)]


@pytest.fixture(scope="module")
def frames(spark):
    us = F.lit(START) + F.col("id") * 1_700_000
    return spark.range(300).select(
        F.timestamp_micros(us).alias("ts"), us.alias("us"), (F.col("id") * 7 % 3).alias("vehicle_id"),
        F.col("id").alias("seq"), (F.col("id") * 13 % 5).cast("double").alias("value"),
        F.col("id").alias("n")).cache()


def marker(spark, rows):
    """A row of another vehicle far ahead moves the watermark past all others."""
    end = spark.range(1).select(
        F.timestamp_micros(F.lit(FLUSH)).alias("ts"), F.lit(FLUSH).alias("us"),
        F.lit(-1).cast("long").alias("vehicle_id"), F.lit(-1).cast("long").alias("seq"))
    return end.select(*[F.col(c) if c in end.columns else F.lit(None).cast(k).alias(c)
                        for c, k in rows.dtypes])


def test_labels_by_intervals_that_arrive_late(spark, frames, tmp_path):
    """Overlapping, long, empty and unordered intervals, the last of them far behind its rows."""
    log = spark.createDataFrame(
        [(0, 10, 95, "a"), (0, 20, 40, "b"), (0, 20, 40, "c"), (1, 0, 500, "d"), (1, 100, 130, "e"),
         (2, 33, 33, "none"), (2, 200, 205, "f"), (2, 199, 420, "g"), (5, 0, 10, "h")],
        "vehicle_id long, s long, e long, attack_type string").select(
        "vehicle_id", F.timestamp_micros(F.lit(START) + F.col("s") * 1_000_000).alias("start_time"),
        F.timestamp_micros(F.lit(START) + F.col("e") * 1_000_000).alias("end_time"), "attack_type")
    end = spark.range(1).select(
        F.lit(-1).cast("long").alias("vehicle_id"), F.timestamp_micros(F.lit(FLUSH)).alias("start_time"),
        F.timestamp_micros(F.lit(FLUSH + 1)).alias("end_time"), F.lit("end").alias("attack_type"))
    parts = dealt(frames.drop("us"), 11)
    rows = landed(spark, str(tmp_path / "rows"), [*parts, marker(spark, parts[0].withColumn(
        "us", F.lit(0).cast("long"))).drop("us")])
    logs = [log.where("attack_type in ('e', 'f')"), log.where("attack_type in ('b', 'h', 'none')"),
            log.where("attack_type in ('a', 'c', 'd', 'g')"), end]
    got = sinks.finish(joins.label_by_intervals(
        rows, landed(spark, str(tmp_path / "log"), logs), 60, "10 minutes", "20 minutes"), "labels")
    want = state.label_by_intervals(frames.drop("us", "n"), log)
    same(got.where("vehicle_id >= 0"), want)
    named = got.where("in_attack").select("attack_type").distinct().collect()
    assert {r[0] for r in named} == {"a", "d", "g"}


def test_asof_merge_of_two_feeds(spark, frames, tmp_path):
    """The right feed is sparse, with nulls and equal times, and comes later than the left one."""
    right = frames.where("seq % 9 in (0, 4)").select(
        "ts", "us", "vehicle_id", (F.col("seq") + 1000).alias("seq"),
        F.when(F.col("seq") % 2 == 0, F.col("value") * 10).alias("x"),
        F.concat(F.lit("p"), F.col("seq").cast("string")).alias("name"), "n")
    left_parts, right_parts = dealt(frames, 7), dealt(right, 5)
    left_stream = landed(spark, str(tmp_path / "l"), [*left_parts, marker(spark, left_parts[0])])
    right_stream = landed(spark, str(tmp_path / "r"), [*right_parts, marker(spark, right_parts[0])])
    got = sinks.finish(joins.asof_merge(
        left_stream, right_stream, ["x", "name"], "10 minutes", "20 minutes"), "asof")
    want = state.asof_merge(frames.drop("n"), right.drop("n"), ["x", "name"]).drop("ts")
    same(got.where("vehicle_id >= 0"), want)
    assert got.where("name is null").count() < 120  # one vehicle has no right rows
