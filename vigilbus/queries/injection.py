"""Labelled anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.operators import inject, windows
from vigilbus.queries.registry import query, with_sql
from vigilbus.queries.windows import NUMBERED_SQL, checksum
from vigilbus.schema import WINDOW_FEATURES
from vigilbus.sources import views
from vigilbus.sources.views import TELEMETRY_SQL


def u(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def steps(change: dict[int, str]) -> str:
    """Weighted sum over one step with some features replaced by other expressions."""
    return " + ".join(
        f"((b.rn - a.rn) * 8 + {i + 1}) * ({change.get(i, 'b.' + f)})"
        for i, f in enumerate(WINDOW_FEATURES))


BASE = """FROM num a JOIN num b ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn AND a.rn + 19
WHERE a.rn + 19 <= a.n"""
GROUP = " GROUP BY a.vehicle_id, a.seq, a.rn"
STEP = "(b.rn - a.rn)"
WKEY = ("a.vehicle_id", "a.seq")
SPIKED = {
    i: f"b.{f} + CASE WHEN {STEP} = floor({u('42r', *WKEY)} * 20) AND floor({u('42c', *WKEY)} * 8) = {i} THEN 8.0 ELSE 0.0 END"
    for i, f in enumerate(WINDOW_FEATURES)}
DRIFTED = {0: f"b.speed_kmh + CASE WHEN {STEP} >= 10 THEN ({STEP} - 10) * (3.0::DOUBLE / 9) ELSE 0.0 END"}
WAVED = {4: f"2.0 * sin(pi() * {STEP})"}
SPLICED = {i: f"CASE WHEN {STEP} >= 10 THEN c.{f} ELSE b.{f} END" for i, f in enumerate(WINDOW_FEATURES)}


def _sql(change):
    return with_sql(NUMBERED_SQL, f"""
SELECT a.vehicle_id, a.seq AS start_seq, round(sum({steps(change)}), 4) AS checksum {BASE} {GROUP}""")


def _windows(spark, sf):
    return windows.sliding(views.telemetry(spark, sf)).select("vehicle_id", "start_seq", "w")


@query("k02_spike", _sql(SPIKED))
def spike(spark, sf):
    return _windows(spark, sf).select(
        "vehicle_id", "start_seq", checksum(inject.spike(F.col("w"), 42)))


@query("k03_drift", _sql(DRIFTED))
def drift(spark, sf):
    return _windows(spark, sf).select("vehicle_id", "start_seq", checksum(inject.drift(F.col("w"))))


@query("k04_frequency", _sql(WAVED))
def frequency(spark, sf):
    return _windows(spark, sf).select(
        "vehicle_id", "start_seq", checksum(inject.frequency(F.col("w"))))


WINDOWS_SQL = """win AS (SELECT vehicle_id, seq AS start_seq, rn, row_number() OVER (ORDER BY vehicle_id, seq) AS i,
  count(*) OVER () AS total, row_number() OVER (ORDER BY md5('42|' || vehicle_id || '|' || seq), vehicle_id, seq) AS rank
  FROM num WHERE rn + 19 <= n)"""
DONOR_SQL = """don AS (SELECT x.vehicle_id, x.start_seq, y.vehicle_id AS donor_vehicle_id, y.start_seq AS donor_start_seq, y.rn AS donor_rn
  FROM win x JOIN win y ON y.i = (x.i - 1 + x.total // 2) % x.total + 1)"""


@query("d06_splice_donors", with_sql(NUMBERED_SQL, WINDOWS_SQL, DONOR_SQL, """
SELECT vehicle_id, start_seq, donor_vehicle_id, donor_start_seq FROM don"""))
def splice_donors(spark, sf):
    return inject.donors(_windows(spark, sf))


SPLICE_FROM = f"""FROM num a JOIN num b ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn AND a.rn + 19
JOIN don ON don.vehicle_id = a.vehicle_id AND don.start_seq = a.seq
JOIN num c ON c.vehicle_id = don.donor_vehicle_id AND c.rn = don.donor_rn + {STEP} WHERE a.rn + 19 <= a.n"""


@query("k05_splice", with_sql(NUMBERED_SQL, WINDOWS_SQL, DONOR_SQL, f"""
SELECT a.vehicle_id, a.seq AS start_seq, round(sum({steps(SPLICED)}), 4) AS checksum {SPLICE_FROM} {GROUP}"""))
def splice(spark, sf):
    rows = _windows(spark, sf)
    both = inject.with_donor(rows, inject.donors(rows))
    return both.select("vehicle_id", "start_seq", checksum(inject.splice(F.col("w"), F.col("donor_w"))))


PICK_SQL = """pick AS (SELECT vehicle_id, start_seq, ['spike', 'drift', 'frequency', 'splice'][CAST((rank - 1) % 4 + 1 AS BIGINT)] AS kind
  FROM win WHERE rank <= floor(total * 0.3::DOUBLE))"""


@query("k01_pick_windows", with_sql(NUMBERED_SQL, WINDOWS_SQL, PICK_SQL, "SELECT vehicle_id, start_seq, kind FROM pick"))
def pick_windows(spark, sf):
    return inject.pick(_windows(spark, sf), 0.3, 42)


def _kind_case(i: int, f: str) -> str:
    return (f"CASE k.kind WHEN 'spike' THEN {SPIKED[i]} WHEN 'splice' THEN {SPLICED[i]} "
            + (f"WHEN 'drift' THEN {DRIFTED[0]} " if i == 0 else "")
            + (f"WHEN 'frequency' THEN {WAVED[4]} " if i == 4 else "") + f"ELSE b.{f} END")


@query("h02_inject_labelled_anomalies", with_sql(NUMBERED_SQL, WINDOWS_SQL, DONOR_SQL, PICK_SQL, f"""
SELECT a.vehicle_id, a.seq AS start_seq, coalesce(any_value(k.kind), 'benign') AS kind,
  CASE WHEN any_value(k.kind) IS NULL THEN 0 ELSE 1 END AS label,
  round(sum({steps({i: _kind_case(i, f) for i, f in enumerate(WINDOW_FEATURES)})}), 4) AS checksum
{SPLICE_FROM.replace('WHERE', 'LEFT JOIN pick k ON k.vehicle_id = a.vehicle_id AND k.start_seq = a.seq WHERE')} {GROUP}"""))
def inject_labelled_anomalies(spark, sf):
    return inject.inject(_windows(spark, sf)).select(
        "vehicle_id", "start_seq", "kind", "label", checksum())


ROW = ("vehicle_id", "seq")


@query("k06_row_tampering", with_sql(TELEMETRY_SQL, f"""
t AS (SELECT *, {u('1h', *ROW)} < 0.1 AS tampered, CASE WHEN {u('1h', *ROW)} < 0.1
  THEN ['speed', 'gps', 'both'][CAST(floor({u('1t', *ROW)} * 3) AS BIGINT) + 1] ELSE 'none' END AS tampering_type FROM tel)""", f"""
SELECT vehicle_id, seq, tampered, tampering_type,
  CASE WHEN tampering_type IN ('speed', 'both') THEN round(31 + 19 * {u('1s', *ROW)}, 2) ELSE speed_kmh END AS speed_kmh,
  round(CASE WHEN tampering_type IN ('gps', 'both') THEN location_x + (1000 + 4000 * {u('1location_x', *ROW)}) ELSE location_x END, 6) AS location_x,
  round(CASE WHEN tampering_type IN ('gps', 'both') THEN location_y + (1000 + 4000 * {u('1location_y', *ROW)}) ELSE location_y END, 6) AS location_y FROM t"""))
def row_tampering(spark, sf):
    return inject.tamper(views.telemetry(spark, sf)).select(
        "vehicle_id", "seq", "tampered", "tampering_type", "speed_kmh",
        *[F.round(c, 6).alias(c) for c in ("location_x", "location_y")])


@query("k07_masquerade", with_sql(TELEMETRY_SQL, """
SELECT seq, 'vehicle.fake.model' AS vehicle_model, throttle, 1.0::DOUBLE AS brake FROM tel"""))
def masquerade(spark, sf):
    packets = views.telemetry(spark, sf).select(
        "seq", F.lit("model").alias("vehicle_model"), F.struct("throttle", "brake").alias("control"))
    return inject.masquerade(packets).select("seq", "vehicle_model", "control.throttle", "control.brake")


@query("k08_replay", with_sql(NUMBERED_SQL, f"""
h AS (SELECT *, {u('3h', *ROW)} < 0.1 AND rn > 1 AS replayed, floor({u('3i', *ROW)} * (rn - 1)) + 1 AS src FROM num)""", """
SELECT h.vehicle_id, h.seq, h.replayed, CASE WHEN h.replayed THEN s.speed_kmh ELSE h.speed_kmh END AS speed_kmh,
  CASE WHEN h.replayed THEN s.brake ELSE h.brake END AS brake
FROM h LEFT JOIN num s ON s.vehicle_id = h.vehicle_id AND h.replayed AND s.rn = h.src"""))
def replay(spark, sf):
    rows = views.telemetry(spark, sf).select("vehicle_id", "ts", "seq", "speed_kmh", "brake")
    return inject.replay(rows, ["speed_kmh", "brake"]).drop("ts")


@query("k09_flood", with_sql(TELEMETRY_SQL, """
SELECT vehicle_id, seq, CAST(c AS INTEGER) AS copy, speed_kmh FROM tel, (SELECT unnest(range(1, 11)) AS c)"""))
def flood(spark, sf):
    return inject.flood(views.telemetry(spark, sf)).select("vehicle_id", "seq", "copy", "speed_kmh")
