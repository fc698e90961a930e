"""Thresholds from sketches over several micro-batches against exact ranks."""

from pyspark.sql import functions as F

from vigilbus.operators import evaluate
from vigilbus.streaming import sources, thresholds


def test_thresholds_follow_new_scores(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(60_000).select(
        F.when(i % 20 == 0, i % 3).when(i % 50 == 7, None).otherwise(9).alias("vehicle_id"),
        F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, None).otherwise(
            F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0).alias("score"), i.alias("at"))
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    done = None
    for part in range(3):
        rows.where(f"at % 3 = {part}").drop("at").coalesce(1).write.mode("append").parquet(source)
        stream = sources.files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        thresholds.follow(stream, folder, k=512).awaitTermination()
        got = {r["vehicle_id"]: r for r in thresholds.latest(spark, folder).collect()}
        good = rows.where(f"at % 3 <= {part} AND NOT isnan(score)").where("score IS NOT NULL")
        exact = {r["vehicle_id"]: r for r in evaluate.calibrate(good, by=["vehicle_id"]).collect()}
        # The exact form leaves out rows without a key.
        assert {k: r["n"] for k, r in got.items() if k is not None} == {k: r["n"] for k, r in exact.items()}
        assert set(got) == {*range(part + 1), 9, None}
        for key, r in got.items():
            mine = good.where(F.col("vehicle_id").eqNullSafe(F.lit(key)))
            rank = mine.agg(F.avg((F.col("score") * 1.5 <= r["threshold"] + 1e-9).cast("double"))).first()[0]
            assert abs(rank - 0.99) <= 2 * thresholds.rank_error(512) + 1 / r["n"]
        assert done is None or done < got[9]["n"]
        done = got[9]["n"]


def test_few_scores_give_no_threshold(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    spark.range(20).selectExpr("1L AS vehicle_id", "CAST(id AS double) AS score").write.parquet(source)
    stream = sources.files(spark, source, spark.read.parquet(source).schema)
    thresholds.follow(stream, folder).awaitTermination()
    assert [tuple(r) for r in thresholds.latest(spark, folder).collect()] == [(1, 20, None)]
