"""Scores of a stream take up a new round of weights at a batch and keep it when the batch runs again."""

import numpy as np
from pyspark.sql import functions as F

from vigilbus.models import nets
from vigilbus.operators import federated, windows
from vigilbus.streaming import batches, scoring, sources

RESULT = "vehicle_id long, end_seq long, score double, round int, alarm boolean"


def save(spark, net, seed, number, path):
    rows = [(k, i, float(x), number) for k, v in net.init(seed).items()
            for i, x in enumerate(np.asarray(v).ravel())]
    federated.save_round(spark.createDataFrame(rows, "key string, idx int, value double, round int"), path)


def test_scores_switch_with_the_round_and_stay_when_repeated(spark, tmp_path):
    net = nets.GruAutoencoder(features=2)
    source, models, folder = (str(tmp_path / n) for n in ("in", "models", "run"))
    us = F.lit(1_700_000_000_000_000) + F.col("id") * 100_000
    rows = spark.range(120).select(
        F.timestamp_micros(us).alias("ts"), us.alias("us"), (F.col("id") % 2).alias("vehicle_id"),
        F.col("id").alias("seq"), F.sin(F.col("id") / 3).alias("a"), F.cos(F.col("id") / 5).alias("b"))
    limits = spark.createDataFrame([(1, -1.0), (2, 1e9)], "round int, threshold double")

    def go_on():
        s = sources.files(spark, source, rows.schema, files_per_trigger=1)
        scoring.score_with_newest(s, net, ["a", "b"], models, limits, folder).awaitTermination()
        found = batches.results(spark, folder, RESULT).collect()
        return {(r.vehicle_id, r.end_seq): r for r in found}

    for part, seed in ((0, 1), (1, 2)):
        save(spark, net, seed, part + 1, models)
        rows.where(f"seq div 60 = {part}").coalesce(1).write.mode("append").parquet(source)
        got = go_on()
    want = {}
    for w in windows.sliding(rows, ["a", "b"]).collect():
        flat = np.array([np.ravel(w.w)], float)
        want[(w.vehicle_id, w.end_seq)] = net.scores(net.init(1 if w.end_seq < 60 else 2), flat)[0]
    assert set(got) == set(want)
    for place, r in got.items():
        assert abs(r.score - want[place]) < 1e-6  # scores are 32-bit sums
        assert (r.round, r.alarm) == ((1, True) if place[1] < 60 else (2, False))

    # A third round lands, and the second batch runs again because its commit was lost.
    save(spark, net, 3, 3, models)
    for name in ("1", ".1.crc"):
        (tmp_path / "run" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert go_on() == got
