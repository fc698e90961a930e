"""Heavy keys must give the same rows as the plain window, whatever the block size."""

import pytest
from pyspark.sql import functions as F

from vigilbus.operators import declared, evaluate, features, federated, state, windows
from vigilbus.plans import stats
from vigilbus.plans.series import lay_out, positions, running, trailing_count


@pytest.fixture(scope="module")
def skewed(spark):
    """Vehicle 1 holds a third of all rows, many in one instant; one key is null."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 100 == 1, None)
        .otherwise(F.col("id") % 40 + 2).cast("int").alias("vehicle_id"),
        F.when(F.col("id") % 7 < 3, F.lit(1_000_000)).otherwise(F.col("id") * 10_000)
        .alias("us"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 5 == 0, (F.col("id") * 37 % 101).cast("double")).alias("x"),
    ).withColumn("ts", F.timestamp_micros("us"))
    return rows.cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(cols).collect()))
    right = sorted(map(str, b.select(cols).collect()))
    assert left == right


@pytest.mark.parametrize("target", [40, 333])
def test_running_equals_plain(skewed, target):
    values = {
        "s": ("sum", F.col("x")), "c": ("count", F.col("x")), "lo": ("min", F.col("x")),
        "hi": ("max", F.col("x")), "ff": ("last", F.col("x")),
    }
    args = (skewed, ["vehicle_id"], ["ts", "seq"], values)
    same(running(*args), running(*args, target_rows=target))


def test_only_heavy_keys_are_blocked(skewed):
    assert not lay_out(skewed, ["vehicle_id"], ["ts", "seq"]).blocked
    laid = lay_out(skewed, ["vehicle_id"], ["ts", "seq"], target_rows=100)
    sizes = laid.df.groupBy("vehicle_id", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert laid.df.where("_block > 0").select("vehicle_id").distinct().count() == 1


@pytest.mark.parametrize("target", [50, 400])
def test_rolling_equals_plain(skewed, target):
    same(features.signal_statistics(skewed, ["x"], 10),
         features.signal_statistics(skewed, ["x"], 10, target_rows=target))
    same(features.inter_arrival(skewed), features.inter_arrival(skewed, target_rows=target))


def test_trailing_count_equals_plain(skewed):
    args = (skewed, ["vehicle_id"], "ts", 500_000, "n")
    same(trailing_count(*args), trailing_count(*args, target_rows=100))


def test_positions_over_all_rows(skewed):
    a = positions(skewed, [], ["us", "seq"], "p")
    b = positions(skewed, [], ["us", "seq"], "p", target_rows=100)
    same(a, b)
    assert a.agg(F.min("p"), F.max("p"), F.count_distinct("p")).first()[:] == (1, 3000, 3000)


def test_grid_and_intervals_equal_plain(skewed):
    s = skewed.withColumn("v", F.coalesce("x", F.lit(0.0)))
    same(state.sample_grid(s, ["v"], 70_000), state.sample_grid(s, ["v"], 70_000, target_rows=90))
    log = skewed.where("seq % 97 = 0").select(
        "vehicle_id", F.lit("dos").alias("attack_type"), F.col("ts").alias("start_time"),
        F.timestamp_micros(F.col("us") + 400_000).alias("end_time"))
    same(state.label_by_intervals(skewed, log), state.label_by_intervals(skewed, log, target_rows=90))


def test_percentiles_and_auroc(skewed):
    rows = skewed.where("x is not null").withColumn("label", (F.col("seq") % 2).cast("int"))
    got = stats.percentiles(rows, "x", {"p50": 0.5, "p99": 0.99}, ["vehicle_id"], target_rows=10)
    want = rows.groupBy("vehicle_id").agg(
        F.count("x").alias("n"), F.percentile("x", 0.5).alias("p50"),
        F.percentile("x", 0.99).alias("p99"))
    rounded = [F.round(c, 9).alias(c) for c in ("p50", "p99")]
    same(got.where("vehicle_id is not null").select("vehicle_id", "n", *rounded),
         want.where("vehicle_id is not null").select("vehicle_id", "n", *rounded))
    data = [(r.x, r.label) for r in rows.collect()]
    pos = [x for x, y in data if y == 1]
    neg = [x for x, y in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    for target in (None, 10):
        assert stats.auroc(rows, "x", "label", target_rows=target).first()["auroc"] == pytest.approx(
            wins / len(pos) / len(neg))


def test_threshold_sweep_equals_brute_force(skewed):
    rows = skewed.where("x is not null").select(
        F.col("x").alias("score"), (F.col("seq") % 3 % 2).cast("int").alias("label"))
    data = [(r.score, r.label) for r in rows.collect()]
    for target in (None, 20):
        got = evaluate.threshold_sweep(rows, target_rows=target).collect()
        points = rows.select(F.percentile("score", F.array(*[F.lit(p) for p in evaluate.sweep_fractions()]))).first()[0]
        assert sorted(r["threshold"] for r in got) == pytest.approx(sorted(set(points)))
        for r in got:
            assert r["tp"] == sum(s > r["threshold"] and y == 1 for s, y in data)
            assert r["tn"] == sum(s <= r["threshold"] and y == 0 for s, y in data)


def test_higher_operators_equal_plain(skewed):
    s = skewed.withColumn("speed_kmh", F.coalesce("x", F.lit(0.0)))
    same(windows.sliding(s, ["speed_kmh"]), windows.sliding(s, ["speed_kmh"], target_rows=60))
    same(windows.training(s, ["speed_kmh"], stride=7), windows.training(s, ["speed_kmh"], stride=7, target_rows=60))
    same(features.newest_rows(s, 30), features.newest_rows(s, 30, target_rows=60))
    same(features.edge_features(s.withColumns({"throttle": F.lit(1.0), "brake": F.lit(2.0)})),
         features.edge_features(s.withColumns({"throttle": F.lit(1.0), "brake": F.lit(2.0)}), target_rows=120))


def test_multi_pass_operators_equal_plain(skewed):
    same(declared.fill_missing(skewed, "x"), declared.fill_missing(skewed, "x", target_rows=200))
    cycles = skewed.where("seq % 3 = 0").select(
        F.col("vehicle_id").alias("client_id"), F.col("seq").alias("cycle"),
        (F.col("seq") * 31 % 97).cast("double").alias("loss"))
    same(federated.rollback(cycles), federated.rollback(cycles, target_rows=200))


def test_results_do_not_depend_on_partitions(spark, skewed):
    seen = set()
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = features.signal_statistics(skewed.repartition(int(n)), ["x"], 10, target_rows=300)
        seen.add(tuple(sorted(map(str, rows.select("seq", "x_delta").collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
