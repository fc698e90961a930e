"""State, as-of merges and per-vehicle features on the signals view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.operators import device, features, state
from vigilbus.queries.registry import query, with_sql
from vigilbus.sources import views
from vigilbus.sources.views import ATTACK_LOG_SQL, SIGNALS_SQL, TELEMETRY_SQL

HOURS_US = 3_600_000_000
RATE_SPAN = 6 * HOURS_US
VEHICLE_WINDOW = "PARTITION BY vehicle_id ORDER BY ts, seq"

RATE_SQL = f"""rated AS (
  SELECT *, count(*) OVER (PARTITION BY vehicle_id, signal ORDER BY us
     RANGE BETWEEN {RATE_SPAN - 1} PRECEDING AND CURRENT ROW) AS rate FROM sig)"""


def rated_signals(spark, sf):
    rows = views.signals(spark, sf).select("ts", "vehicle_id", "seq", "signal")
    return features.message_rate(rows, ["vehicle_id", "signal"], RATE_SPAN, 1, 2)


@query("rate_alert_report", with_sql(SIGNALS_SQL, RATE_SQL, """
SELECT vehicle_id, signal, max(rate) AS peak_rate,
  count(*) FILTER (rate > 1) AS suspicious_rows, count(*) FILTER (rate > 2) AS attack_rows,
  min(us) FILTER (rate > 1) AS first_us, max(us) FILTER (rate > 1) AS last_us
FROM rated GROUP BY vehicle_id, signal HAVING count(*) FILTER (rate > 1) > 0"""))
def rate_alert_report(spark, sf):
    keys = ["vehicle_id", "signal"]
    return features.rate_alerts(rated_signals(spark, sf), keys)


@query("f03_message_rate", with_sql(SIGNALS_SQL, RATE_SQL, """
SELECT vehicle_id, signal, seq, rate, rate > 1 AS is_suspicious, rate > 2 AS is_attack FROM rated"""))
def message_rate(spark, sf):
    return rated_signals(spark, sf).drop("ts")


@query("f04_bus_rate", with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, seq, count(*) OVER (PARTITION BY vehicle_id ORDER BY us
  RANGE BETWEEN {RATE_SPAN - 1} PRECEDING AND CURRENT ROW) AS rate FROM sig"""))
def bus_rate(spark, sf):
    rows = views.signals(spark, sf).select("ts", "vehicle_id", "seq")
    return features.message_rate(rows, ["vehicle_id"], RATE_SPAN).select(
        "vehicle_id", "seq", "rate")


@query("e03_peak_rate", with_sql(SIGNALS_SQL, RATE_SQL, "SELECT max(rate) AS peak_rate FROM rated"))
def peak_rate(spark, sf):
    return rated_signals(spark, sf).agg(F.max("rate").alias("peak_rate"))


@query("f18_alert_hold", with_sql(SIGNALS_SQL, RATE_SQL, """
held AS (SELECT vehicle_id, signal, seq, us, max(CASE WHEN rate > 1 THEN us END) OVER (
    PARTITION BY vehicle_id, signal ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last_us FROM rated)""", f"""
SELECT vehicle_id, signal, seq, coalesce(us - last_us <= {3 * HOURS_US}, false) AS alert_on FROM held"""))
def alert_hold(spark, sf):
    return features.alert_hold(
        rated_signals(spark, sf), ["vehicle_id", "signal"], 3 * HOURS_US, "is_suspicious"
    ).select("vehicle_id", "signal", "seq", "alert_on")


@query("d02_state_assembly", with_sql(TELEMETRY_SQL, """
SELECT vehicle_id, seq, speed_kmh, battery_level, throttle, brake, steering FROM tel"""))
def state_assembly(spark, sf):
    return state.assemble_state(views.signals(spark, sf)).drop("ts", "gear")


@query("d02_state_zero_defaults", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, seq,
  coalesce(last_value(CASE WHEN signal='battery_level' THEN value END IGNORE NULLS) OVER w, 0.0) AS battery_level,
  coalesce(last_value(CASE WHEN signal='brake' THEN value END IGNORE NULLS) OVER w, 0.0) AS brake
FROM sig WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"""))
def state_zero_defaults(spark, sf):
    zero = {"battery_level": 0.0, "brake": 0.0}
    return state.assemble_state(views.signals(spark, sf), zero).drop("ts")


LOCATION_SQL = """loc AS (
  SELECT vehicle_id, us, seq, value * 2 AS x, value - 5 AS y FROM sig WHERE k % 10 = 3)"""


def location_feed(spark, sf):
    return views.signals(spark, sf).where("k % 10 = 3").select(
        "vehicle_id", "ts", "seq", (F.col("value") * 2).alias("x"), (F.col("value") - 5).alias("y")
    )


@query("d03_location_asof", with_sql(SIGNALS_SQL, LOCATION_SQL, """
SELECT s.vehicle_id, s.seq, l.x, l.y FROM sig s ASOF LEFT JOIN loc l
  ON s.vehicle_id = l.vehicle_id AND s.us >= l.us"""))
def location_asof(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq")
    return state.asof_merge(rows, location_feed(spark, sf), ["x", "y"]).drop("ts")


METRIC_SQL = """met AS (
  SELECT vehicle_id, us, k / 2.0::DOUBLE AS cpu_temperature_c FROM sig WHERE k % 4 = 1)"""


@query("d04_device_metric_asof", with_sql(SIGNALS_SQL, METRIC_SQL, """
SELECT s.vehicle_id, s.seq, s.value, coalesce(m.cpu_temperature_c, 0.0) AS cpu_temperature_c
FROM (SELECT * FROM sig WHERE k % 4 <> 1) s ASOF LEFT JOIN met m
  ON s.vehicle_id = m.vehicle_id AND s.us >= m.us"""))
def device_metric_asof(spark, sf):
    rows = views.signals(spark, sf)
    gauges = rows.where("k % 4 = 1").select(
        "vehicle_id", "ts", "seq", (F.col("k") / 2.0).alias("cpu_temperature_c"))
    fast = rows.where("k % 4 <> 1").select("vehicle_id", "ts", "seq", "value")
    return state.asof_merge(
        fast, gauges, ["cpu_temperature_c"], defaults={"cpu_temperature_c": 0.0}
    ).drop("ts")


@query("d05_attack_interval_labels", with_sql(SIGNALS_SQL, ATTACK_LOG_SQL, """
SELECT s.vehicle_id, s.seq, count(a.start_us) > 0 AS in_attack,
       arg_max(a.attack_type, (a.end_us, a.attack_type)) AS attack_type
FROM sig s LEFT JOIN atk a ON s.vehicle_id = a.vehicle_id AND s.us >= a.start_us AND s.us < a.end_us
GROUP BY s.vehicle_id, s.seq"""))
def attack_interval_labels(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq")
    log = views.attack_log(spark, sf)
    return state.label_by_intervals(rows, log).select(
        "vehicle_id", "seq", "in_attack", "attack_type")


GRID_STEP = 12 * HOURS_US


@query("j03_state_grid", with_sql(TELEMETRY_SQL, f"""
nxt AS (SELECT *, lead(us) OVER ({VEHICLE_WINDOW}) - 1 AS until_us FROM tel)""", f"""
pts AS (SELECT vehicle_id, speed_kmh, brake, unnest(range((us + {GRID_STEP} - 1) // {GRID_STEP},
  coalesce(until_us, us) // {GRID_STEP} + 1)) AS p FROM nxt)""", f"""
SELECT vehicle_id, p * {GRID_STEP} AS grid_us, speed_kmh, brake FROM pts"""))
def state_grid(spark, sf):
    rows = state.assemble_state(views.signals(spark, sf))
    return state.sample_grid(rows, ["speed_kmh", "brake"], GRID_STEP)


@query("f01_deltas", with_sql(TELEMETRY_SQL, f"""
SELECT vehicle_id, seq,
  coalesce(speed_kmh - lag(speed_kmh) OVER ({VEHICLE_WINDOW}), 0.0) AS speed_kmh_delta,
  coalesce(brake - lag(brake) OVER ({VEHICLE_WINDOW}), 0.0) AS brake_delta FROM tel"""))
def deltas(spark, sf):
    rows = views.telemetry(spark, sf)
    return features.deltas(rows, ["speed_kmh", "brake"]).select(
        "vehicle_id", "seq", "speed_kmh_delta", "brake_delta")


@query("f02_signal_statistics", with_sql(TELEMETRY_SQL, f"""
SELECT vehicle_id, seq, {", ".join(f'''
  coalesce({c} - lag({c}) OVER ({VEHICLE_WINDOW}), 0.0) AS {c}_delta,
  round(avg({c}) OVER w, 6) AS {c}_mean, round(coalesce(stddev_pop({c}) OVER w, 0.0), 6) AS {c}_std'''
  for c in ("speed_kmh", "throttle"))}
FROM tel WINDOW w AS ({VEHICLE_WINDOW} ROWS 9 PRECEDING)"""))
def signal_statistics(spark, sf):
    out = features.signal_statistics(views.telemetry(spark, sf), ["speed_kmh", "throttle"], 10)
    return out.select(
        "vehicle_id", "seq",
        *[F.col(f"{c}_delta") for c in ("speed_kmh", "throttle")],
        *[F.round(f"{c}_{s}", 6).alias(f"{c}_{s}")
          for c in ("speed_kmh", "throttle") for s in ("mean", "std")],
    )


@query("f05_row_rate", with_sql(SIGNALS_SQL, f"""
r AS (SELECT vehicle_id, seq, count(*) OVER w AS n, (us - min(us) OVER w) / 1000000.0::DOUBLE AS span
  FROM sig WINDOW w AS ({VEHICLE_WINDOW} ROWS 99 PRECEDING))""", """
SELECT vehicle_id, seq, round(CASE WHEN n = 1 THEN 1.0 WHEN span > 0 THEN n / span
  ELSE n::DOUBLE END, 9) AS message_frequency FROM r"""))
def row_rate(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq")
    return features.row_rate(rows).select(
        "vehicle_id", "seq", F.round("message_frequency", 9).alias("message_frequency"))


@query("f06_inter_arrival", with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, seq, coalesce((us - lag(us) OVER ({VEHICLE_WINDOW})) / 1000000.0::DOUBLE, 0.1::DOUBLE)
  AS inter_arrival_time FROM sig"""))
def inter_arrival(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq")
    return features.inter_arrival(rows).drop("ts")


@query("f07_dispersion", with_sql(TELEMETRY_SQL, f"""
d AS (SELECT vehicle_id, seq, count(*) OVER w AS n, stddev_pop(speed_kmh) OVER w AS s,
  avg(speed_kmh) OVER w AS m FROM tel WINDOW w AS ({VEHICLE_WINDOW} ROWS 9 PRECEDING))""", """
SELECT vehicle_id, seq, round(CASE WHEN n = 10 AND s > 0 THEN least(1.0, s / (m + 1e-8)) ELSE 0.0 END, 6)
  AS payload_entropy FROM d"""))
def dispersion(spark, sf):
    rows = views.telemetry(spark, sf).select("vehicle_id", "ts", "seq", "speed_kmh")
    return features.dispersion(rows).select(
        "vehicle_id", "seq", F.round("payload_entropy", 6).alias("payload_entropy"))


@query("b17_edge_feature_vector", with_sql(TELEMETRY_SQL, f"""
w AS (SELECT *,
    coalesce(speed_kmh - lag(speed_kmh) OVER ({VEHICLE_WINDOW}), 0.0) AS dlt,
    count(*) OVER h AS n, (us - min(us) OVER h) / 1000000.0::DOUBLE AS span,
    coalesce((us - lag(us) OVER ({VEHICLE_WINDOW})) / 1000000.0::DOUBLE, 0.1::DOUBLE) AS gap,
    count(*) OVER t AS n10, stddev_pop(speed_kmh) OVER t AS s10, avg(speed_kmh) OVER t AS m10
  FROM tel WINDOW h AS ({VEHICLE_WINDOW} ROWS 99 PRECEDING), t AS ({VEHICLE_WINDOW} ROWS 9 PRECEDING))""", """
SELECT vehicle_id, seq, speed_kmh AS f0, battery_level AS f1, throttle AS f2, brake AS f3, steering AS f4, gear AS f5, location_x AS f6, location_y AS f7,
  round(dlt, 6) AS f8,
  round(CASE WHEN throttle + brake > 0 THEN throttle * brake / 100 ELSE 0.0 END, 6) AS f9,
  round(CASE WHEN n = 1 THEN 1.0 WHEN span > 0 THEN n / span ELSE n::DOUBLE END, 9) AS f10,
  round(gap, 6) AS f11,
  round(CASE WHEN n10 = 10 AND s10 > 0 THEN least(1.0, s10 / (m10 + 1e-8)) ELSE 0.0 END, 6) AS f12,
  """ + ", ".join(f"0.0::DOUBLE AS f{i}" for i in range(13, 25)) + """, 25 AS width FROM w"""))
def edge_feature_vector(spark, sf):
    rows = features.edge_features(views.telemetry(spark, sf))
    v = F.col("features")
    digits = {8: 6, 9: 6, 10: 9, 11: 6, 12: 6}
    return rows.select(
        "vehicle_id", "seq",
        *[(F.round(v[i], digits[i]) if i in digits else v[i]).alias(f"f{i}")
          for i in range(25)],
        F.size(v).alias("width"),
    )


@query("b24_throttle_brake_product", with_sql(TELEMETRY_SQL, """
SELECT vehicle_id, seq, CASE WHEN throttle + brake > 0 THEN throttle * brake / 100 ELSE 0.0 END
  AS throttle_brake_ratio FROM tel"""))
def throttle_brake_product(spark, sf):
    return views.telemetry(spark, sf).select(
        "vehicle_id", "seq",
        features.throttle_brake(F.col("throttle"), F.col("brake")).alias("throttle_brake_ratio"))


@query("b15_speed_from_velocity", with_sql(TELEMETRY_SQL, """
SELECT vehicle_id, seq, round(3.6 * sqrt(throttle * throttle + brake * brake), 6) AS speed_2d,
  round(3.6 * sqrt(throttle * throttle + brake * brake + steering * steering), 6) AS speed_3d FROM tel"""))
def speed_from_velocity(spark, sf):
    x, y, z = F.col("throttle"), F.col("brake"), F.col("steering")
    return views.telemetry(spark, sf).select(
        "vehicle_id", "seq", F.round(features.speed_kmh(x, y), 6).alias("speed_2d"),
        F.round(features.speed_kmh(x, y, z), 6).alias("speed_3d"))


@query("b16_charge_estimate", with_sql(TELEMETRY_SQL, f"""
SELECT vehicle_id, seq, round(greatest(0.0, 100.0 - sum(throttle * 0.1::DOUBLE) OVER ({VEHICLE_WINDOW}
  ROWS UNBOUNDED PRECEDING)), 6) AS charge FROM tel"""))
def charge_estimate(spark, sf):
    rows = views.telemetry(spark, sf).select("vehicle_id", "ts", "seq", "throttle")
    return features.charge_estimate(rows).select(
        "vehicle_id", "seq", F.round("charge", 6).alias("charge"))


@query("f13_newest_rows", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, seq, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, seq DESC) AS recency
FROM sig QUALIFY recency <= 20"""))
def newest_rows(spark, sf):
    rows = views.signals(spark, sf).select("vehicle_id", "ts", "seq")
    return features.newest_rows(rows, 20).select(
        "vehicle_id", "seq", F.col("recency").cast("long").alias("recency"))


@query("f14_changed_rows", with_sql(TELEMETRY_SQL, f"""
b AS (SELECT vehicle_id, seq, ts, speed_kmh, brake, attacked, row_number() OVER v AS rn,
   lag(speed_kmh) OVER v AS ps, lag(brake) OVER v AS pb, lag(attacked) OVER v AS pa
   FROM tel WINDOW v AS ({VEHICLE_WINDOW}))""", """
SELECT vehicle_id, seq, speed_kmh, brake, attacked FROM b WHERE rn = 1 OR speed_kmh IS DISTINCT FROM ps
  OR brake IS DISTINCT FROM pb OR attacked IS DISTINCT FROM pa"""))
def changed_rows(spark, sf):
    rows = views.telemetry(spark, sf)
    return features.changed_rows(rows, ["speed_kmh", "brake", "attacked"]).select(
        "vehicle_id", "seq", "speed_kmh", "brake", "attacked")


COUNTERS_SQL = """cnt AS (SELECT vehicle_id, ts, seq, us // 10000 AS total, us // 20000 + k AS idle,
  4000000 AS mem_total, 1000000 + k * 10000 AS mem_available, 40000 + k * 250 AS temp_milli,
  'throttled=0x' || printf('%x', CASE WHEN k % 3 = 0 THEN 0 ELSE k * 256 END) AS flag FROM sig)"""


def raw_counters(spark, sf):
    us, k = F.unix_micros("ts"), F.col("k")
    return views.signals(spark, sf).select(
        "vehicle_id", "ts", "seq",
        F.expr("unix_micros(ts) div 10000").alias("total"),
        (F.expr("unix_micros(ts) div 20000") + k).alias("idle"),
        F.lit(4_000_000).alias("mem_total"), (1_000_000 + k * 10_000).alias("mem_available"),
        (40_000 + k * 250).alias("temp_milli"),
        F.concat(F.lit("throttled=0x"), F.lower(F.hex(F.when(k % 3 == 0, 0).otherwise(k * 256))))
        .alias("flag"),
    )


@query("b22_cpu_usage", with_sql(SIGNALS_SQL, COUNTERS_SQL, f"""
SELECT vehicle_id, seq, round(coalesce(100.0::DOUBLE * (1 - (idle - lag(idle) OVER v)::DOUBLE /
  nullif(total - lag(total) OVER v, 0)), 0.0), 6) AS cpu_usage_percent FROM cnt WINDOW v AS ({VEHICLE_WINDOW})"""))
def cpu_usage(spark, sf):
    rows = raw_counters(spark, sf).select("vehicle_id", "ts", "seq", "idle", "total")
    return device.cpu_usage(rows).select(
        "vehicle_id", "seq", F.round("cpu_usage_percent", 6).alias("cpu_usage_percent"))


@query("b23_device_gauges", with_sql(SIGNALS_SQL, COUNTERS_SQL, """
SELECT vehicle_id, seq, round((mem_total - mem_available) / 1024.0::DOUBLE, 6) AS memory_used_mb,
  round(100.0::DOUBLE * (mem_total - mem_available) / mem_total, 6) AS memory_usage_percent,
  temp_milli / 1000.0::DOUBLE AS cpu_temperature_c,
  CASE WHEN flag LIKE '%=0x0' THEN 0 ELSE 1 END AS throttling_state FROM cnt"""))
def device_gauges(spark, sf):
    total, free = F.col("mem_total"), F.col("mem_available")
    return raw_counters(spark, sf).select(
        "vehicle_id", "seq",
        F.round(device.memory_used_mb(total, free), 6).alias("memory_used_mb"),
        F.round(device.memory_percent(total, free), 6).alias("memory_usage_percent"),
        device.temperature_c(F.col("temp_milli")).alias("cpu_temperature_c"),
        device.throttling_state(F.col("flag")).alias("throttling_state"),
    )
