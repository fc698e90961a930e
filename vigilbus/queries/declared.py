"""Detectors, generators and policies known only from declared settings."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from vigilbus.operators import declared as D
from vigilbus.operators import features
from vigilbus.queries.injection import u
from vigilbus.queries.registry import query, with_sql
from vigilbus.queries.signals import RATE_SQL, rated_signals
from vigilbus.queries.signals import raw_counters
from vigilbus.schema import weight_shapes
from vigilbus.sources import views
from vigilbus.sources.views import SCORES_SQL, SIGNALS_SQL, UPDATES_SQL

V = "PARTITION BY vehicle_id, signal ORDER BY ts, seq"
ROW = ("vehicle_id", "seq")


@query("m01_repeated_sequences", with_sql(SIGNALS_SQL, f"""
rr AS (SELECT vehicle_id, signal, seq, floor(value / 100) AS b1, lag(floor(value / 100)) OVER v AS b2, lag(floor(value / 100), 2) OVER v AS b3, row_number() OVER v AS rn
  FROM sig WINDOW v AS ({V}))""", """
SELECT vehicle_id, signal, count(*) AS times, min(seq) AS first_seq, max(seq) AS last_seq FROM rr WHERE rn >= 3
GROUP BY vehicle_id, signal, b1, b2, b3 HAVING count(*) > 1"""))
def repeated_sequences(spark, sf):
    coarse = views.signals(spark, sf).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    return D.repeated_sequences(coarse, 3).drop("run")


@query("m01_value_deviation", with_sql(SIGNALS_SQL, f"""
d AS (SELECT vehicle_id, signal, seq, row_number() OVER ({V}) AS rn, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s
  FROM sig WINDOW w AS ({V} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""", """
SELECT vehicle_id, signal, seq, CASE WHEN rn > 10 THEN round((value - m) / nullif(s, 0), 6) END AS z,
  coalesce(rn > 10 AND abs((value - m) / nullif(s, 0)) > 3, false) AS is_deviation FROM d"""))
def value_deviation(spark, sf):
    return D.deviation(views.signals(spark, sf)).select(
        "vehicle_id", "signal", "seq", F.round("z", 6).alias("z"), "is_deviation")


@query("m01_missing_messages", with_sql(SIGNALS_SQL, f"""
g AS (SELECT vehicle_id, signal, seq, us - lag(us) OVER ({V}) AS gap_us FROM sig)""", """
m AS (SELECT vehicle_id, signal, quantile_cont(gap_us, 0.5) AS median_us FROM g WHERE gap_us IS NOT NULL GROUP BY 1, 2)""", """
SELECT vehicle_id, signal, seq, gap_us FROM g JOIN m USING (vehicle_id, signal) WHERE gap_us > 3 * median_us"""))
def missing_messages(spark, sf):
    return D.missing_messages(views.signals(spark, sf)).select("vehicle_id", "signal", "seq", "gap_us")


@query("m01_trend", with_sql(SIGNALS_SQL, f"""
n AS (SELECT *, row_number() OVER ({V}) AS rn FROM sig)""", f"""
SELECT vehicle_id, signal, seq, CASE WHEN rn >= 10 THEN round(regr_slope(value, rn) OVER (PARTITION BY vehicle_id, signal ORDER BY rn ROWS 9 PRECEDING), 6) END AS slope FROM n"""))
def trend(spark, sf):
    return D.trend(views.signals(spark, sf)).select(
        "vehicle_id", "signal", "seq", F.round("slope", 6).alias("slope"))


@query("m01_trend_with_gaps", with_sql(SIGNALS_SQL, f"""
n AS (SELECT *, CASE WHEN seq % 5 <> 0 THEN value END AS y, row_number() OVER ({V}) AS rn FROM sig)""", """
SELECT vehicle_id, signal, seq, CASE WHEN rn >= 10 THEN round(regr_slope(y, rn) OVER (PARTITION BY vehicle_id, signal ORDER BY rn ROWS 9 PRECEDING), 9) END AS slope FROM n"""))
def trend_with_gaps(spark, sf):
    """Every fifth value is missing; the others keep their places."""
    rows = views.signals(spark, sf).withColumn("value", F.when(F.col("seq") % 5 != 0, F.col("value")))
    return D.trend(rows).select("vehicle_id", "signal", "seq", F.round("slope", 9).alias("slope"))


@query("m01_bursts", with_sql(SIGNALS_SQL, RATE_SQL, f"""
s AS (SELECT *, CASE WHEN rate > 1 AND NOT coalesce(lag(rate > 1) OVER ({V}), false) THEN 1 ELSE 0 END AS st FROM rated)""", f"""
b AS (SELECT *, sum(st) OVER ({V} ROWS UNBOUNDED PRECEDING) AS burst FROM s)""", """
SELECT vehicle_id, signal, CAST(burst AS BIGINT) AS burst, count(*) AS "rows", max(rate) AS peak_rate, min(us) AS start_us, max(us) AS end_us
FROM b WHERE rate > 1 GROUP BY 1, 2, 3"""))
def bursts(spark, sf):
    return D.bursts(rated_signals(spark, sf), ["vehicle_id", "signal"])


def _out(rows):
    return rows.select("vehicle_id", "seq", F.unix_micros("ts").alias("us"),
                       F.round("value", 6).alias("value"), "attack")


def _generated(spark, sf, kind):
    return _out(D.generate(views.signals(spark, sf).drop("k"), kind))


def hit(kind: str, rate: float = 0.2) -> str:
    return f"{u('21' + kind, *ROW)} < {rate}"


PLAIN = "SELECT vehicle_id, seq, us, round(value, 6) AS value, NULL::VARCHAR AS attack FROM sig"


def copies_sql(kind: str, where: str, copies: int, gap: int) -> str:
    return with_sql(SIGNALS_SQL, f"""{PLAIN} UNION ALL
SELECT vehicle_id, seq, us + c * {gap}, round(value, 6), '{kind}' FROM sig, (SELECT unnest(range(1, {copies + 1})) AS c) WHERE {where}""")


@query("m02_generate_dos_flood", copies_sql("dos_flood", hit("dos_flood"), 10, 1000))
def generate_dos_flood(spark, sf):
    return _generated(spark, sf, "dos_flood")


@query("m02_generate_burst_injection", copies_sql("burst_injection", "us // 1000 % 500 < 50", 10, 1000))
def generate_burst(spark, sf):
    return _generated(spark, sf, "burst_injection")


@query("m02_generate_replay", copies_sql("replay", hit("replay"), 1, 100_000))
def generate_replay(spark, sf):
    return _generated(spark, sf, "replay")


@query("m02_generate_suspension", with_sql(SIGNALS_SQL, f"{PLAIN} WHERE NOT {hit('suspension')}"))
def generate_suspension(spark, sf):
    return _generated(spark, sf, "suspension")


def changed_sql(kind: str, when: str, value: str) -> str:
    return with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, seq, us, round(CASE WHEN {when} THEN {value} ELSE value END, 6) AS value, CASE WHEN {when} THEN '{kind}' END AS attack FROM sig""")


@query("m02_generate_fuzzing", changed_sql("fuzzing", hit("fuzzing", 0.3), f"{u('21v', *ROW)} * 255"))
def generate_fuzzing(spark, sf):
    return _generated(spark, sf, "fuzzing")


@query("m02_generate_spoofing", changed_sql("spoofing", hit("spoofing"), f"value * (1 + ({u('21v', *ROW)} * 2 - 1) * 0.5)"))
def generate_spoofing(spark, sf):
    return _generated(spark, sf, "spoofing")


@query("m02_generate_targeted_id", changed_sql("targeted_id", f"({hit('targeted_id')} AND signal = 'speed_kmh')", "value * 2"))
def generate_targeted(spark, sf):
    return _generated(spark, sf, "targeted_id")


@query("m02_generate_gradual_drift", with_sql(SIGNALS_SQL, f"""
n AS (SELECT *, row_number() OVER ({V}) - 1 AS i FROM sig)""", """
SELECT vehicle_id, seq, us, round(value * (1 + 0.01::DOUBLE * i), 6) AS value, CASE WHEN i > 0 THEN 'gradual_drift' END AS attack FROM n"""))
def generate_drift(spark, sf):
    return _generated(spark, sf, "gradual_drift")


GAPS_SQL = "gp AS (SELECT vehicle_id, ts, us, seq, CASE WHEN k % 3 <> 0 THEN value END AS value FROM sig)"


def with_gaps(spark, sf):
    return views.signals(spark, sf).select(
        "vehicle_id", "ts", "seq", F.when(F.col("k") % 3 != 0, F.col("value")).alias("value"))


@query("m03_missing_interpolate", with_sql(SIGNALS_SQL, GAPS_SQL, """
p AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS av, last_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER a AS t0,
  first_value(value IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER b AS t1 FROM gp
  WINDOW a AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING),
         b AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", """
SELECT vehicle_id, seq, round(coalesce(value, av + (bv - av) * ((us - t0)::DOUBLE / nullif(t1 - t0, 0)), av, bv), 6) AS value FROM p"""))
def missing_interpolate(spark, sf):
    return D.fill_missing(with_gaps(spark, sf), "value").select(
        "vehicle_id", "seq", F.round("value", 6).alias("value"))


@query("m03_missing_zero", with_sql(SIGNALS_SQL, GAPS_SQL, "SELECT vehicle_id, seq, coalesce(value, 0.0) AS value FROM gp"))
def missing_zero(spark, sf):
    return D.fill_missing(with_gaps(spark, sf), "value", "zero").drop("ts")


@query("m03_missing_drop", with_sql(SIGNALS_SQL, GAPS_SQL, "SELECT vehicle_id, seq, value FROM gp WHERE value IS NOT NULL"))
def missing_drop(spark, sf):
    return D.fill_missing(with_gaps(spark, sf), "value", "drop").drop("ts")


@query("m04_time_and_rolling_features", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, seq, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, round(avg(value) OVER w, 6) AS value_mean, round(stddev_pop(value) OVER w, 6) AS value_std
FROM sig WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS 9 PRECEDING)"""))
def time_and_rolling(spark, sf):
    rows = features.signal_statistics(views.signals(spark, sf), ["value"], 10)
    return D.time_features(rows).select(
        "vehicle_id", "seq", "hour", "minute", F.round("value_mean", 6).alias("value_mean"),
        F.round("value_std", 6).alias("value_std"))


MODEL_BYTES = 4 * sum(prod(s) for s in weight_shapes().values())


@query("m05_tracked_metrics", with_sql(SCORES_SQL, UPDATES_SQL, f"""
q AS (SELECT avg(score) AS anomaly_score, avg(CASE WHEN label = 1 THEN CAST(score > 900 AS INTEGER) END) AS detection_rate,
  avg(CASE WHEN label = 0 THEN CAST(score > 900 AS INTEGER) END) AS false_positive_rate FROM sc)""", f"""
w AS (SELECT avg(loss) AS reconstruction_loss, avg(num_samples * 2)::DOUBLE AS round_duration, count(*) * {MODEL_BYTES}.0::DOUBLE AS communication_overhead, {MODEL_BYTES}.0::DOUBLE AS model_size_bytes FROM upd)""", """
SELECT metric, round(value, 6) AS value FROM (UNPIVOT q ON anomaly_score, detection_rate, false_positive_rate INTO NAME metric VALUE value
UNION ALL UNPIVOT w ON reconstruction_loss, round_duration, communication_overhead, model_size_bytes INTO NAME metric VALUE value)"""))
def tracked_metrics(spark, sf):
    rounds = views.client_updates(spark, sf).withColumn("duration_s", F.col("num_samples") * 2)
    out = D.tracked_metrics(views.scored_documents(spark, sf), 900.0, rounds, MODEL_BYTES)
    return out.withColumn("value", F.round("value", 6))


@query("a09_device_metric_scan", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, count(*) AS samples, min(us // 10000) AS first_total, max(us // 10000) AS last_total, max(40000 + k * 250) AS hottest_milli FROM sig GROUP BY vehicle_id"""))
def device_metric_scan(spark, sf):
    return raw_counters(spark, sf).groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("total").alias("first_total"),
        F.max("total").alias("last_total"), F.max("temp_milli").alias("hottest_milli"))
