"""Plausibility rule queries on the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.operators import rules
from vigilbus.queries.registry import query, with_sql
from vigilbus.sources import views
from vigilbus.sources.views import SIGNALS_SQL, TELEMETRY_SQL

RANGE_TERMS = [
    ("speed_kmh > 300", "speed_high"), ("speed_kmh < -50", "speed_low"),
    ("battery_level > 100", "battery_level_high"), ("battery_level < 0", "battery_level_low"),
    ("throttle > 100", "throttle_high"), ("throttle < 0", "throttle_low"),
    ("brake > 100", "brake_high"), ("brake < 0", "brake_low"),
]


def _joined(terms) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in terms) + ")"


JUMPS = """j AS (SELECT *,
  coalesce(abs(speed_kmh - lag(speed_kmh) OVER v) > 50, false) AS speed_jump,
  coalesce(abs(battery_level - lag(battery_level) OVER v) > 10, false) AS battery_jump
  FROM tel WINDOW v AS (PARTITION BY vehicle_id ORDER BY ts, seq))"""
ALL_TERMS = RANGE_TERMS + [
    ("throttle > 80 AND brake > 80", "throttle_and_brake"), ("speed_jump", "speed_jump"),
    ("battery_jump", "battery_jump"),
]


@query("c01_driving_alerts", with_sql(TELEMETRY_SQL, """
SELECT seq, 'high_speed' AS alert FROM tel WHERE speed_kmh > 100
UNION ALL SELECT seq, 'hard_brake' FROM tel WHERE brake / 100 > 0.7"""))
def driving_alerts(spark, sf):
    alerts = rules.driving_alerts(F.col("speed_kmh"), F.col("brake") / 100)
    return views.telemetry(spark, sf).select("seq", F.explode(alerts).alias("alert"))


@query("c02_range_rules", with_sql(TELEMETRY_SQL, f"SELECT seq, {_joined(RANGE_TERMS)} AS rules FROM tel"))
def range_rules(spark, sf):
    return views.telemetry(spark, sf).select(
        "seq", F.concat_ws(",", rules.range_rules()).alias("rules"))


@query("c03_both_pedals", with_sql(TELEMETRY_SQL, """
SELECT seq, throttle > 80 AND brake > 80 AS both_pedals FROM tel"""))
def both_pedals(spark, sf):
    return views.telemetry(spark, sf).select("seq", rules.both_pedals().alias("both_pedals"))


@query("c04_rapid_change", with_sql(TELEMETRY_SQL, JUMPS, "SELECT seq, speed_jump, battery_jump FROM j"))
def rapid_change(spark, sf):
    return rules.rapid_change(views.telemetry(spark, sf)).select(
        "seq", "speed_jump", "battery_jump")


@query("c05_row_validity", with_sql(SIGNALS_SQL, """
SELECT seq, k % 6 = 5 AS valid FROM sig"""))
def row_validity(spark, sf):
    k = F.col("k") % 6
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(
        k > 3, F.col("value"))
    rows = views.signals(spark, sf).select(
        "seq", bad.alias("speed_kmh"), F.when(k != 4, F.col("value")).alias("brake"))
    return rows.select("seq", rules.is_valid(["speed_kmh", "brake"]).alias("valid"))


@query("all_rules_report", with_sql(TELEMETRY_SQL, JUMPS, f"""
SELECT vehicle_id, seq, {_joined(ALL_TERMS)} AS rules FROM j"""))
def all_rules_report(spark, sf):
    return rules.all_rules(views.telemetry(spark, sf)).select(
        "vehicle_id", "seq", F.concat_ws(",", "rules").alias("rules"))


RISK_SQL = with_sql(TELEMETRY_SQL, JUMPS, f"""
r AS (SELECT vehicle_id, seq, location_y / 100 AS p, {_joined(ALL_TERMS)} <> '' AS fired FROM j)""", """
d AS (SELECT vehicle_id, seq, CASE WHEN p > 0.5 THEN 'attack' WHEN p > 0.3 THEN 'elevated' ELSE 'normal' END AS tier,
  p > 0.5 OR fired AS is_attack, CASE WHEN fired AND p > 0.3 THEN least(p + 0.2::DOUBLE, 1.0) ELSE p END AS confidence FROM r)""", """
SELECT * FROM d""")


def _risk(spark, sf):
    rows = rules.all_rules(views.telemetry(spark, sf))
    fired = F.size("rules") > 0
    return rows.select("vehicle_id", "seq", *[
        c.alias(n) for n, c in rules.risk(F.col("location_y") / 100, fired).items()])


@query("c11_risk_tiers", RISK_SQL)
def risk_tiers(spark, sf):
    return _risk(spark, sf)


@query("e04_detection_counters", RISK_SQL.replace("SELECT * FROM d", """
SELECT tier, count(*) AS "rows", count(*) FILTER (is_attack) AS detections,
  round(100.0 * avg(CAST(is_attack AS INTEGER)), 6) AS detection_rate FROM d GROUP BY tier"""))
def detection_counters(spark, sf):
    return rules.detection_counters(_risk(spark, sf), ["tier"]).withColumn(
        "detection_rate", F.round("detection_rate", 6))


@query("c10_anomaly_predicate", with_sql(SIGNALS_SQL, """
SELECT seq, coalesce(value > CASE WHEN vehicle_id % 3 <> 0 THEN 60.0 END, false) AS is_anomaly FROM sig"""))
def anomaly_predicate(spark, sf):
    limit = F.when(F.col("vehicle_id") % 3 != 0, 60.0)
    return views.signals(spark, sf).select(
        "seq", rules.is_anomaly(F.col("value"), limit).alias("is_anomaly"))
