"""State API streams and micro-batch plans: initial state, silent and busy vehicles, late rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilbus.models import nets
from vigilbus.operators import features, state, windows
from vigilbus.streaming import batches, sinks, sources, stateful

START = 1_700_000_000_000_000
DEFAULTS = {"speed_kmh": 0.0, "brake": 0.0}


@pytest.fixture(scope="module")
def busy(spark):
    """2,000 rows of four vehicles, nine tenths of them of vehicle 0."""
    i = F.col("id")
    us = F.lit(START) + i * 61_000
    return spark.range(2000).select(
        F.timestamp_micros(us).alias("ts"), us.alias("us"),
        F.when(i % 10 != 0, 0).otherwise(1 + i % 3).cast("long").alias("vehicle_id"), i.alias("seq"),
        F.when(i % 2 == 0, "speed_kmh").otherwise("brake").alias("signal"),
        (i * 13 % 5).cast("double").alias("value")).cache()


@pytest.fixture
def wide_shuffle(spark):
    """32 tasks a shuffle, none merged, so that rows a task can be counted."""
    names = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def landed(spark, folder, parts):
    """A folder with one file for each part, as a stream of one file a micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return sources.files(spark, folder, parts[0].schema, files_per_trigger=1)


def quarters(rows):
    return [rows.where(f"seq div {500} = {i}") for i in range(4)]


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def most_in_a_task(out):
    """Largest share of the rows that one task wrote."""
    counts = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    return max(counts) / sum(counts)


def test_rate_blocks_split_a_busy_vehicle(spark, busy, wide_shuffle, tmp_path):
    s = landed(spark, str(tmp_path / "in"), [busy]).select("vehicle_id", "signal", "us", "seq")
    got = sinks.finish(stateful.exact_rate(s, 1_000_000, block_us=1_000_000), "blocks")
    want = features.message_rate(busy, ["vehicle_id", "signal"], 1_000_000)
    same(got, want.select("vehicle_id", "signal", "seq", "rate"))
    assert most_in_a_task(got) <= 0.2
    with pytest.raises(ValueError, match="as long as the span"):
        stateful.exact_rate(s, 1_000_000, block_us=999_999)


def test_streams_go_on_from_initial_state(spark, busy, tmp_path):
    """The second half, started from what the first half left, gives what one run gives."""
    first, second = busy.where("seq < 1000"), busy.where("seq >= 1000")
    s = landed(spark, str(tmp_path / "in"), quarters(second)[2:])
    columns = ["vehicle_id", "us", "seq", "signal", "value"]
    newest = first.groupBy("vehicle_id", "signal").agg(
        F.max_by(F.struct("us", "seq", "value"), F.struct("us", "seq")).alias("r")).select(
        "vehicle_id", "signal", "r.*")
    got = sinks.finish(stateful.changed_state(s.select(columns), DEFAULTS, initial=newest), "go-on")
    want = features.changed_rows(state.assemble_state(busy, DEFAULTS), list(DEFAULTS))
    same(got, want.drop("ts").where("seq >= 1000"))

    got = sinks.finish(stateful.exact_rate(
        s.select("vehicle_id", "signal", "us", "seq"), 2_000_000, block_us=3_000_000,
        initial=first.select("vehicle_id", "signal", "us")), "go-on-rate")
    want = features.message_rate(busy, ["vehicle_id", "signal"], 2_000_000)
    same(got, want.where("seq >= 1000").select("vehicle_id", "signal", "seq", "rate"))

    vectors = ["vehicle_id", "us", "seq", F.array("value").alias("v")]
    got = sinks.finish(stateful.online_windows(
        s.select(vectors), 1, initial=first.select(vectors)), "go-on-windows")
    want = windows.sliding(busy, ["value"]).where("end_seq >= 1000")
    same(got, want.select("vehicle_id", "end_seq", F.flatten("w").alias("flat")))


def test_grid_goes_on_for_silent_vehicles(spark, busy, tmp_path):
    """Vehicle 2 falls silent after the first file; rows inside a file and across files are shuffled."""
    rows = busy.where("vehicle_id <> 2 OR seq < 400")
    # Every eleventh row arrives one file later, within the delay.
    part = F.least(F.expr("seq div 500") + F.when(F.col("seq") % 11 == 0, 1).otherwise(0), F.lit(3))
    dealt = rows.withColumn("_p", part)
    parts = [dealt.where(f"_p = {i}").drop("_p").orderBy(F.xxhash64("seq")) for i in range(4)]
    s = landed(spark, str(tmp_path / "in"), parts)
    got = sinks.finish(stateful.state_grid(s, 1_000_000, "40 seconds", DEFAULTS), "grid").cache()
    closed = busy.agg(F.max("us")).first()[0] // 1000 * 1000 - 40_000_000
    before = state.assemble_state(rows.where(F.col("us") < closed), DEFAULTS)
    same(got, state.sample_grid(before, list(DEFAULTS), 1_000_000, until_us=F.lit(closed)))
    silent = got.where("vehicle_id = 2").agg(F.max("grid_us"), F.count("*")).first()
    assert silent[0] == got.agg(F.max("grid_us")).first()[0] and silent[1] > 50
    kept = sinks.finish(stateful.state_grid(s, 1_000_000, "40 seconds", DEFAULTS, keep_s=10.0), "kept")
    last = rows.where("vehicle_id = 2").agg(F.max("us")).first()[0]
    want = got.where((F.col("vehicle_id") != 2) | (F.col("grid_us") <= last + 10_000_000))
    same(kept, want)


def test_grid_state_is_kept_by_shares(spark, busy, tmp_path):
    """200 vehicles, one without id, in three shares: the state store holds and wakes shares, not vehicles."""
    vehicle = F.when(F.col("seq") % 200 != 7, F.col("seq") % 200)
    rows = busy.withColumn("vehicle_id", vehicle).where("seq < 1500 OR vehicle_id < 150").cache()
    untimed = rows.where("seq % 100 = 3").withColumns({
        "ts": F.lit(None).cast("timestamp"), "us": F.lit(None).cast("long")})
    part = F.least(F.expr("seq div 500") + F.when(F.col("seq") % 11 == 0, 1).otherwise(0), F.lit(3))
    dealt = rows.withColumn("_p", part)
    parts = [dealt.where(f"_p = {i}").drop("_p").orderBy(F.xxhash64("seq")) for i in range(4)]
    s = landed(spark, str(tmp_path / "in"), [parts[0].union(untimed), *parts[1:]])
    grid = stateful.state_grid(s, 1_000_000, "40 seconds", DEFAULTS, shares=3)
    out = str(tmp_path / "out")
    running = sinks.to_files(grid, out, str(tmp_path / "state"))
    running.awaitTermination()
    closed = rows.agg(F.max("us")).first()[0] // 1000 * 1000 - 40_000_000
    before = state.assemble_state(rows.where(F.col("us") < closed), DEFAULTS)
    same(spark.read.schema(grid.schema).parquet(out),
         state.sample_grid(before, list(DEFAULTS), 1_000_000, until_us=F.lit(closed)))
    held = [p["stateOperators"][0] for p in running.recentProgress]
    assert 0 < max(h["numRowsTotal"] for h in held) <= 3 * 3  # pending, fleet and next step of each
    assert 0 < max(h["customMetrics"]["numExpiredTimers"] for h in held) <= 3


def test_ttl_streams_run_until_stopped(spark, busy, tmp_path):
    s = landed(spark, str(tmp_path / "in"), [busy.where("seq < 200")])
    rated = stateful.exact_rate(s.select("vehicle_id", "signal", "us", "seq"), 1_000_000, ttl_s=3600.0)
    out = str(tmp_path / "out")
    running = sinks.to_files(rated, out, str(tmp_path / "state"), every="1 second")
    end = time.monotonic() + 90
    while not sum(p["numInputRows"] for p in running.recentProgress) and time.monotonic() < end:
        time.sleep(0.5)
    running.stop()
    want = features.message_rate(busy.where("seq < 200"), ["vehicle_id", "signal"], 1_000_000)
    same(spark.read.schema(rated.schema).parquet(out), want.select("vehicle_id", "signal", "seq", "rate"))
    with pytest.raises(ValueError, match="not both"):
        stateful.exact_rate(s, 1_000_000, "1 second", ttl_s=1.0)


BATCHED = {
    "changed": (lambda n: batches.changed_state(DEFAULTS, n),
                "vehicle_id long, seq long, speed_kmh double, brake double",
                lambda rows: features.changed_rows(
                    state.assemble_state(rows, DEFAULTS), list(DEFAULTS)).drop("ts")),
    "windows": (lambda n: batches.online_windows(["value"], target_rows=n),
                "vehicle_id long, end_seq long, flat array<double>",
                lambda rows: windows.sliding(rows, ["value"]).select(
                    "vehicle_id", "end_seq", F.flatten("w").alias("flat"))),
    "rate": (lambda n: batches.exact_rate(2_000_000, target_rows=n),
             "vehicle_id long, signal string, seq long, rate long",
             lambda rows: features.message_rate(rows, ["vehicle_id", "signal"], 2_000_000).select(
                 "vehicle_id", "signal", "seq", "rate")),
}


@pytest.mark.parametrize("name", list(BATCHED))
def test_batch_plans_split_a_busy_vehicle(spark, busy, wide_shuffle, tmp_path, name):
    """Equal to the batch form over several micro-batches, no task above a fifth of a batch's rows."""
    step, schema, whole = BATCHED[name]
    s = landed(spark, str(tmp_path / "in"), [busy.where("seq < 1200"), busy.where("seq >= 1200")])
    folder = str(tmp_path / "run")
    batches.follow(s, step(30), folder).awaitTermination()
    same(batches.results(spark, folder, schema), whole(busy))
    assert most_in_a_task(spark.read.schema(schema).parquet(f"{folder}/out/batch=0")) <= 0.2


def test_batch_plans_drop_late_rows_and_repeat_a_batch(spark, busy, tmp_path):
    """Late rows do not turn state back; a lost commit makes the last batch run again, to equal rows."""
    folder, source = str(tmp_path / "run"), str(tmp_path / "in")
    rows = busy.where("seq < 300")
    late = rows.where("seq < 40").withColumn("value", F.col("value") + 100).withColumn(
        "seq", F.col("seq") + 10_000)
    step = batches.changed_state(DEFAULTS)
    schema = BATCHED["changed"][1]
    parts = [rows.where("seq < 150"), rows.where("seq >= 150").union(late)]
    batches.follow(landed(spark, source, parts), step, folder).awaitTermination()
    want = features.changed_rows(state.assemble_state(rows, DEFAULTS), list(DEFAULTS)).drop("ts")
    same(batches.results(spark, folder, schema), want)
    for name in ("1", ".1.crc"):
        (tmp_path / "run" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    batches.follow(sources.files(spark, source, rows.schema, files_per_trigger=1), step,
                   folder).awaitTermination()
    same(batches.results(spark, folder, schema), want)


def test_batch_plans_forget_silent_vehicles(spark, busy, tmp_path):
    folder = str(tmp_path / "run")
    rows = busy.where("seq < 400 AND vehicle_id <> 3 OR vehicle_id = 3 AND seq < 100")
    back = busy.where("vehicle_id = 3 AND seq >= 1900")
    s = landed(spark, str(tmp_path / "in"), [rows, back])
    step = batches.changed_state({"speed_kmh": -1.0, "brake": -1.0})
    batches.follow(s, step, folder, keep_s=5.0).awaitTermination()
    first = batches.results(spark, folder, BATCHED["changed"][1]).where(
        "vehicle_id = 3 AND seq >= 1900").orderBy("seq").first()
    assert -1.0 in (first["speed_kmh"], first["brake"])


def test_online_scores_are_those_of_the_windows(spark, busy, tmp_path):
    net = nets.GruAutoencoder(features=1)
    rows = busy.where("seq < 300").withColumn("v", F.array(F.col("value") / 5))
    s = landed(spark, str(tmp_path / "in"), [rows.where("seq < 150"), rows.where("seq >= 150")])
    got = sinks.finish(stateful.online_scores(
        s.select("vehicle_id", "us", "seq", "v"), net, net.init(3)), "scores").collect()
    done = windows.sliding(rows.withColumn("x", F.col("v")[0]), ["x"]).collect()
    flat = np.array([np.ravel(w.w) for w in done], float)
    want = dict(zip([(w.vehicle_id, w.end_seq) for w in done], net.scores(net.init(3), flat), strict=True))
    assert {(r.vehicle_id, r.end_seq) for r in got} == set(want)
    assert all(abs(r.score - want[(r.vehicle_id, r.end_seq)]) < 1e-6 for r in got)
