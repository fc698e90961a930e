"""Streams over several micro-batches give what the batch form gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilbus.operators import features, federated, state, windows
from vigilbus.streaming import sinks, sources, stateful, windowed


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Signals in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("landing"))
    rows = spark.range(400).select(
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 170_000).alias("ts"),
        (F.lit(1_700_000_000_000_000) + F.col("id") * 170_000).alias("us"),
        (F.col("id") * 7 % 3).alias("vehicle_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, "speed_kmh").otherwise("brake").alias("signal"),
        (F.col("id") * 13 % 5).cast("double").alias("value"))
    for i in range(4):
        rows.where(f"seq div 100 = {i}").coalesce(1).write.mode("append").parquet(folder)
    table = spark.read.parquet(folder)
    return folder, table


def stream(spark, landed):
    folder, table = landed
    return sources.files(spark, folder, table.schema, files_per_trigger=1)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_exact_rate(spark, landed):
    s = stream(spark, landed).select("vehicle_id", "signal", "us", "seq")
    got = sinks.finish(stateful.exact_rate(s, 2_000_000), "rate")
    want = features.message_rate(landed[1], ["vehicle_id", "signal"], 2_000_000)
    same(got, want.select("vehicle_id", "signal", "seq", "rate"))


def test_changed_state(spark, landed):
    defaults = {"speed_kmh": 0.0, "brake": 0.0}
    s = stream(spark, landed).select("vehicle_id", "us", "seq", "signal", "value")
    got = sinks.finish(stateful.changed_state(s, defaults), "changed")
    want = features.changed_rows(state.assemble_state(landed[1], defaults), list(defaults))
    same(got, want.drop("ts"))


def test_online_windows(spark, landed):
    s = stream(spark, landed).select("vehicle_id", "us", "seq", F.array("value").alias("v"))
    got = sinks.finish(stateful.online_windows(s, 1), "windows")
    want = windows.sliding(landed[1], ["value"]).select("vehicle_id", "end_seq", F.flatten("w").alias("flat"))
    same(got, want)


@pytest.mark.parametrize("delay", [None, "5 seconds"])
def test_late_rows_do_not_turn_state_back(spark, landed, tmp_path, delay):
    """The third file also repeats rows of the first under new numbers, long after their time."""
    folder = str(tmp_path / "late")
    table = landed[1].orderBy("seq")
    late = table.where("seq % 20 = 3 AND seq < 60").selectExpr(
        "ts", "us", "vehicle_id", "seq + 10000 AS seq", "signal", "value + 100 AS value")
    parts = [table.where(f"seq div 100 = {i}") for i in range(4)]
    parts[2] = parts[2].union(late)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    s = sources.files(spark, folder, table.schema, files_per_trigger=1)
    defaults = {"speed_kmh": 0.0, "brake": 0.0}
    rows = s.select("ts", "vehicle_id", "us", "seq", "signal", "value")
    got = sinks.finish(stateful.changed_state(rows, defaults, delay), "changed")
    want = features.changed_rows(state.assemble_state(landed[1], defaults), list(defaults))
    same(got, want.drop("ts"))
    vectors = s.select("ts", "vehicle_id", "us", "seq", F.array("value").alias("v"))
    got = sinks.finish(stateful.online_windows(vectors, 1, delay=delay), "windows")
    want = windows.sliding(landed[1], ["value"]).select(
        "vehicle_id", "end_seq", F.flatten("w").alias("flat"))
    same(got, want)
    if delay:  # behind the watermark: counted nowhere
        got = sinks.finish(stateful.exact_rate(rows, 2_000_000, delay), "rate")
        rate = features.message_rate(landed[1], ["vehicle_id", "signal"], 2_000_000)
        same(got, rate.select("vehicle_id", "signal", "seq", "rate"))


def test_silent_keys_lose_their_state(spark, landed, tmp_path):
    """A vehicle that comes back after the time-out starts anew."""
    folder = str(tmp_path / "silent")
    table = landed[1].orderBy("seq")
    back = table.where("vehicle_id = 0 AND seq >= 300")
    for part in (table.where("vehicle_id = 0 AND seq < 100"),
                 *[table.where(f"vehicle_id <> 0 AND seq div 100 = {i}") for i in (0, 1, 2)], back):
        part.coalesce(1).write.mode("append").parquet(folder)
    s = sources.files(spark, folder, table.schema, files_per_trigger=1)
    defaults = {"speed_kmh": -1.0, "brake": -1.0}
    rows = s.select("ts", "vehicle_id", "us", "seq", "signal", "value")
    got = sinks.finish(stateful.changed_state(rows, defaults, "1 second", keep_s=5.0), "changed")
    first = got.where("vehicle_id = 0 AND seq >= 300").orderBy("seq").first()
    assert -1.0 in (first["speed_kmh"], first["brake"])


def test_resends_are_dropped_across_batches(spark, landed, tmp_path):
    folder = str(tmp_path / "twice")
    for _ in range(2):
        landed[1].coalesce(1).write.mode("append").parquet(folder)
    s = sources.files(spark, folder, landed[1].schema, files_per_trigger=1)
    got = sinks.finish(windowed.without_resends(s, ["vehicle_id", "seq"], "1 day"), "once")
    same(got, landed[1])


def test_sessions(spark, landed):
    got = sinks.finish(windowed.sessions(stream(spark, landed), "300 seconds", "1 second"), "sessions")
    assert got.count() == 0  # one open session per vehicle, not final yet
    early = stream(spark, landed).where("seq < 50 or seq > 390")
    done = sinks.finish(windowed.sessions(early, "2 seconds", "1 second"), "sessions")
    assert done.agg(F.sum("rows")).first()[0] == 50


def test_round_waits_for_enough_clients(spark, tmp_path):
    folder = str(tmp_path / "updates")
    schema = "client_id string, round int, update_id long, num_samples long, loss double, weights array<double>"
    batches = [[("a", 1, 1, 10, 0.5, [1.0, 2.0])], [("a", 1, 2, 10, 0.5, [3.0, 4.0])],
               [("b", 1, 3, 30, 0.5, [7.0, 8.0]), ("b", 2, 4, 30, 0.5, [1.0, 1.0])]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    s = sources.files(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    base = str(tmp_path / "rounds")
    windowed.average_rounds(s, f"{base}/p", f"{base}/r", f"{base}/c").awaitTermination()
    rows = windowed.latest_rounds(spark, f"{base}/r").orderBy("idx").collect()
    assert [(r["round"], r["value"]) for r in rows] == [(1, 6.0), (1, 7.0)]


def test_csv_store_folders(spark, landed, tmp_path):
    rows = sinks.telemetry_csv(stream(spark, landed).select("vehicle_id", "seq", "ts", "value"))
    path = str(tmp_path / "csv")
    sinks.to_files(rows.drop("ts"), path, str(tmp_path / "c"), "csv", ["date"]).awaitTermination()
    assert spark.read.option("header", "true").csv(path).count() == 400
    assert "date=2023-11-14" in {p.name for p in (tmp_path / "csv").iterdir()}


def test_last_row_per_step(spark, landed):
    got = sinks.finish(windowed.sampled_state(stream(spark, landed), ["value"], "10 seconds", "1 second"), "steps")
    slot = F.expr("us div 10000000 * 10000000")
    last = Window.partitionBy("vehicle_id", "start_us").orderBy(F.col("seq").desc())
    want = landed[1].withColumn("start_us", slot).withColumn("r", F.row_number().over(last)).where("r = 1")
    final = landed[1].agg(F.max("us")).first()[0] - 1_000_000
    same(got, want.where(F.col("start_us") + 10_000_000 <= final).select("vehicle_id", "start_us", "seq", "value"))


def test_send_decisions_keep_their_state(spark, tmp_path):
    rows = spark.range(90).select(
        (F.col("id") % 2).alias("client_id"), (F.col("id") * 400.0).alias("time_s"),
        (F.col("id") / 30).cast("int").alias("round"),
        F.array(F.sin(F.col("id") / 50.0), F.lit(0.0)).alias("weights"), F.lit(1.0).alias("loss"))
    folder = str(tmp_path / "cycles")
    for i in range(3):
        rows.where(f"round = {i}").coalesce(1).write.mode("append").parquet(folder)
    s = sources.files(spark, folder, rows.schema, files_per_trigger=1)
    same(sinks.finish(stateful.send_decisions(s), "sends"), federated.send_decisions(rows))
