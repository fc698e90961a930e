"""Threshold, detector quality and reconstruction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.operators import evaluate, features, windows
from vigilbus.plans.stats import auroc
from vigilbus.queries.registry import query, with_sql
from vigilbus.queries.windows import NUMBERED_SQL
from vigilbus.sources import views
from vigilbus.sources.views import SCORES_SQL, SIGNALS_SQL


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("e11_threshold_calibration", with_sql(SCORES_SQL, """
SELECT count(score) AS n, CASE WHEN count(score) > 20 THEN round(quantile_cont(score, 0.99) * 1.5, 6) END AS threshold
FROM sc WHERE label = 1"""))
def threshold_calibration(spark, sf):
    scores = views.scored_documents(spark, sf).where("label = 1")
    return r6(evaluate.calibrate(scores), "threshold")


@query("e11_threshold_per_family", with_sql(SCORES_SQL, """
SELECT kind, count(score) AS n, CASE WHEN count(score) > 20 THEN round(quantile_cont(score, 0.99) * 1.5, 6) END AS threshold
FROM sc GROUP BY kind"""))
def threshold_per_family(spark, sf):
    return r6(evaluate.calibrate(views.scored_documents(spark, sf), by=["kind"]), "threshold")


@query("e12_threshold_p95", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.95), 6) AS threshold
FROM lineitem GROUP BY l_returnflag""")
def threshold_p95(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return r6(evaluate.calibrate(rows, "l_extendedprice", ["l_returnflag"], 0.95, 1.0, 0), "threshold")


@query("e13_score_distribution", with_sql(SCORES_SQL, """
SELECT kind, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99, max(score) AS max
FROM sc GROUP BY kind"""))
def score_distribution(spark, sf):
    out = evaluate.distribution(views.scored_documents(spark, sf), by=["kind"])
    return r6(out, "mean", "p50", "p95", "p99")


CONFUSION_SQL = """c AS (SELECT kind, count(*) FILTER (score > 900 AND label = 1) AS tp, count(*) FILTER (score > 900 AND label = 0) AS fp,
  count(*) FILTER (score <= 900 AND label = 1) AS fn, count(*) FILTER (score <= 900 AND label = 0) AS tn FROM sc GROUP BY kind)"""
QUALITY_SQL = """round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fp_rate"""


@query("e14_confusion", with_sql(SCORES_SQL, CONFUSION_SQL, f"SELECT kind, tp, fp, fn, tn, {QUALITY_SQL} FROM c"))
def confusion(spark, sf):
    out = evaluate.confusion(views.scored_documents(spark, sf), F.lit(900.0), by=["kind"])
    return r6(out, "precision", "recall", "f1", "fp_rate")


AUROC_SQL = """rk AS (SELECT kind, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc)"""


@query("e15_auroc", with_sql(SCORES_SQL, AUROC_SQL, """
SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
   / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auroc FROM rk"""))
def auroc_overall(spark, sf):
    out = auroc(views.scored_documents(spark, sf), "score", "label")
    return out.withColumn("auroc", F.round("auroc", 9))


@query("e15_auroc_by_family", with_sql(SCORES_SQL, """
lo AS (SELECT score, count(*) FILTER (label = 0) AS c FROM sc GROUP BY score)""", """
cu AS (SELECT score, sum(c) OVER (ORDER BY score) - c + c / 2.0::DOUBLE AS below FROM lo)""", """
SELECT kind, count(*) AS positives, round(sum(below) / (count(*) * (SELECT count(*) FROM sc WHERE label = 0)), 9) AS auroc
FROM sc JOIN cu USING (score) WHERE label = 1 GROUP BY kind"""))
def auroc_family(spark, sf):
    out = evaluate.auroc_by_family(views.scored_documents(spark, sf))
    return out.withColumn("auroc", F.round("auroc", 9))


SWEEP_SQL = """g AS (SELECT DISTINCT unnest(quantile_cont(score, [(50.0 + 49.9 * i / 199) / 100 FOR i IN range(200)])) AS threshold FROM sc)""", """
sw AS (SELECT threshold, count(*) FILTER (score > threshold AND label = 1) AS tp, count(*) FILTER (score > threshold AND label = 0) AS fp,
  count(*) FILTER (score <= threshold AND label = 1) AS fn, count(*) FILTER (score <= threshold AND label = 0) AS tn
  FROM sc, g GROUP BY threshold)"""


@query("e16_threshold_sweep", with_sql(SCORES_SQL, *SWEEP_SQL, f"""
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, {QUALITY_SQL} FROM sw"""))
def threshold_sweep(spark, sf):
    out = evaluate.threshold_sweep(views.scored_documents(spark, sf))
    return r6(out, "threshold", "precision", "recall", "f1", "fp_rate")


UNEVEN = [0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999]
UNEVEN_SQL = f"""g AS (SELECT DISTINCT unnest(quantile_cont(score, {UNEVEN})) AS threshold FROM sc)"""


@query("e16_sweep_uneven", with_sql(SCORES_SQL, UNEVEN_SQL, SWEEP_SQL[1], f"""
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, {QUALITY_SQL} FROM sw"""))
def sweep_uneven(spark, sf):
    """Candidate thresholds at percentiles of uneven spacing."""
    out = evaluate.threshold_sweep(views.scored_documents(spark, sf), fractions=UNEVEN)
    return r6(out, "threshold", "precision", "recall", "f1", "fp_rate")


@query("e16_best_threshold", with_sql(SCORES_SQL, *SWEEP_SQL, f"""
q AS (SELECT threshold, {QUALITY_SQL} FROM sw)""", """
SELECT round(threshold, 6) AS threshold, f1, precision, recall FROM q ORDER BY f1 DESC, threshold LIMIT 1"""))
def best_threshold(spark, sf):
    out = evaluate.best_threshold(evaluate.threshold_sweep(views.scored_documents(spark, sf)))
    return r6(out, "threshold", "f1", "precision", "recall")


@query("e17_head_to_head", with_sql(SCORES_SQL, CONFUSION_SQL.replace("kind,", "'long' AS d,").replace("GROUP BY kind", ""),
       CONFUSION_SQL.replace("c AS", "c2 AS").replace("kind,", "'very_long' AS d,").replace("GROUP BY kind", "").replace("900", "2000"), f"""
q AS (SELECT d, {QUALITY_SQL} FROM c UNION ALL SELECT d, {QUALITY_SQL} FROM c2)""", """
SELECT m AS metric, max(v) FILTER (d = 'long') AS long, max(v) FILTER (d = 'very_long') AS very_long FROM (
  SELECT d, 'precision' AS m, precision AS v FROM q UNION ALL SELECT d, 'recall', recall FROM q
  UNION ALL SELECT d, 'f1', f1 FROM q UNION ALL SELECT d, 'fp_rate', fp_rate FROM q) GROUP BY m"""))
def head_to_head(spark, sf):
    scores = views.scored_documents(spark, sf)
    parts = []
    for name, limit in (("long", 900.0), ("very_long", 2000.0)):
        c = evaluate.confusion(scores, F.lit(limit)).select("precision", "recall", "f1", "fp_rate")
        parts.append(c.unpivot([], c.columns, "metric", "value").withColumn("detector", F.lit(name)))
    return r6(evaluate.head_to_head(evaluate.pool(parts), ["long", "very_long"]), "long", "very_long")


@query("e05_recent_score_stats", with_sql(SIGNALS_SQL, """
n AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, seq DESC) AS rn FROM sig)""", """
SELECT vehicle_id, count(*) AS n, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max,
  count(*) FILTER (value > 80) AS above FROM n WHERE rn <= 30 GROUP BY vehicle_id"""))
def recent_score_stats(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq", F.col("value").alias("score"))
    return r6(evaluate.recent_stats(features.newest_rows(rows, 30), F.lit(80.0)), "mean")


PAIRS_SQL = """el AS (SELECT a.vec_id, a.label, p AS pos, CAST(a.embedding[p + 1] AS DOUBLE) AS t, CAST(b.embedding[p + 1] AS DOUBLE) AS r
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (SELECT unnest(range(64)) AS p))"""


def vector_pairs(spark, sf):
    v = views.table(spark, sf, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("x_rec"))
    return v.withColumnRenamed("embedding", "x_true").join(nxt, "vec_id")


def _elements(spark, sf):
    return evaluate.pair_elements(vector_pairs(spark, sf), ["vec_id", "label"])


METRICS_SQL = """round(avg(abs(r - t)), 6) AS mae, round(coalesce(corr(r, t), 0), 6) AS pearson_r,
  round(avg(CAST(abs(r - t) < 0.05 AS INTEGER)), 6) AS tol_0, round(avg(CAST(abs(r - t) < 0.1 AS INTEGER)), 6) AS tol_1"""


@query("e24_reconstruction_per_trial", with_sql(PAIRS_SQL, f"SELECT vec_id, {METRICS_SQL} FROM el GROUP BY vec_id"))
def reconstruction_per_trial(spark, sf):
    out = evaluate.reconstruction(_elements(spark, sf), ["vec_id"], [0.05, 0.1])
    return r6(out, "mae", "pearson_r", "tol_0", "tol_1")


@query("e24_reconstruction_per_feature", with_sql(PAIRS_SQL, f"SELECT CAST(pos AS INTEGER) AS pos, {METRICS_SQL} FROM el GROUP BY pos"))
def reconstruction_per_feature(spark, sf):
    out = evaluate.reconstruction(_elements(spark, sf), ["pos"], [0.05, 0.1])
    return r6(out, "mae", "pearson_r", "tol_0", "tol_1")


@query("e24_tolerance_curve", with_sql(PAIRS_SQL, """
g AS (SELECT 0.2::DOUBLE * i / 40 AS tolerance FROM (SELECT unnest(range(41)) AS i))""", """
SELECT round(tolerance, 6) AS tolerance, round(avg(CAST(abs(r - t) < tolerance AS INTEGER)), 6) AS share
FROM el, g GROUP BY tolerance"""))
def tolerance_curve(spark, sf):
    return r6(evaluate.tolerance_curve(_elements(spark, sf)), "tolerance", "share")


@query("h03_pooled_errors", with_sql(PAIRS_SQL, """
SELECT label % 2 AS trial_group, count(*) AS n, round(sum(abs(r - t)), 4) AS total FROM el GROUP BY 1"""))
def pooled_errors(spark, sf):
    e = _elements(spark, sf).withColumn("error", F.abs(F.col("r") - F.col("t")))
    parts = [e.where(F.col("label") % 2 == i).select(F.lit(i).alias("trial_group"), "error")
             for i in (0, 1)]
    return evaluate.pool(parts).groupBy("trial_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("error"), 4).alias("total"))


@query("g05_best_trial", with_sql(PAIRS_SQL, """
m AS (SELECT vec_id, label, avg(abs(r - t)) AS mae FROM el GROUP BY vec_id, label)""", """
SELECT label, round(min(mae), 6) AS mae, arg_min(vec_id, mae) AS vec_id FROM m GROUP BY label"""))
def best_trial(spark, sf):
    trials = evaluate.reconstruction(_elements(spark, sf), ["vec_id", "label"], [])
    return r6(evaluate.best_trial(trials, ["label"], "mae", ["vec_id"]), "mae")


@query("e29_reconstruction_error", with_sql(PAIRS_SQL, """
st AS (SELECT vec_id, pos // 8 AS step, avg((t - r) * (t - r)) AS e FROM el GROUP BY 1, 2)""", """
SELECT vec_id, round(avg(e), 8) AS window_error, round(max(e), 8) AS worst_step, round(min(e), 8) AS best_step FROM st GROUP BY vec_id"""))
def reconstruction_error(spark, sf):
    rows = vector_pairs(spark, sf).select(
        "vec_id", windows.unflat(F.col("x_true").cast("array<double>"), 8, 8).alias("w"),
        windows.unflat(F.col("x_rec").cast("array<double>"), 8, 8).alias("r"))
    e = evaluate.step_errors(F.col("w"), F.col("r"))
    return rows.select(
        "vec_id",
        F.round(evaluate.squared_error(F.flatten("w"), F.flatten("r")), 8).alias("window_error"),
        F.round(F.array_max(e), 8).alias("worst_step"), F.round(F.array_min(e), 8).alias("best_step"))


@query("e23_bootstrap_interval", with_sql(SIGNALS_SQL, """
v AS (SELECT vehicle_id, avg(value) AS x FROM sig GROUP BY vehicle_id)""", """
n AS (SELECT x, row_number() OVER (ORDER BY vehicle_id) AS i, count(*) OVER () AS n FROM v)""", """
d AS (SELECT b, CAST(floor(CAST('0x' || substr(md5('0|' || b || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * n) AS BIGINT) + 1 AS i
  FROM n, (SELECT unnest(range(10000)) AS b))""", """
m AS (SELECT b, avg(x) AS m FROM d JOIN n USING (i) GROUP BY b)""", """
SELECT round((SELECT avg(x) FROM v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high,
  round((quantile_cont(m, 0.975) - quantile_cont(m, 0.025)) / 2, 6) AS halfwidth FROM m"""))
def bootstrap_interval(spark, sf):
    rows = views.signals(spark, sf).groupBy("vehicle_id").agg(F.avg("value").alias("x"))
    out = evaluate.bootstrap_mean(rows, "x", ["vehicle_id"], n_boot=10_000)
    return r6(out, "mean", "ci_low", "ci_high", "halfwidth")


@query("e31_loss_proxy", with_sql(NUMBERED_SQL, """
w AS (SELECT a.vehicle_id, a.rn, sqrt(avg(b.brake)) AS score FROM num a JOIN num b
  ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn AND a.rn + 19 WHERE a.rn + 19 <= a.n GROUP BY 1, 2)""", """
SELECT vehicle_id, CASE WHEN count(*) >= 10 THEN round(avg(score), 6) END AS loss FROM w WHERE rn <= 100 GROUP BY vehicle_id"""))
def loss_proxy(spark, sf):
    w = windows.sliding(views.telemetry(spark, sf), ["brake"])
    score = F.sqrt(F.aggregate(F.flatten("w"), F.lit(0.0), lambda s, x: s + x) / 20)
    rows = w.select("vehicle_id", "start_us", "start_seq", score.alias("score"))
    return r6(evaluate.loss_proxy(rows, "vehicle_id", ["start_us", "start_seq"]), "loss")
