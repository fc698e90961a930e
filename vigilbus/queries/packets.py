"""Nested packet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.functions import packets as P
from vigilbus.operators import telemetry
from vigilbus.queries.registry import query, with_sql
from vigilbus.schema import PACKET_SIGNALS
from vigilbus.sources import readers, views
from vigilbus.sources.views import PACKETS_SQL

N = P.PACKET_COLUMNS
BUS_TIME = ("coalesce(" + ", ".join(f"CASE WHEN {n}_value IS NOT NULL THEN {n}_raw END" for n in N)
            + ", " + ", ".join(f"{n}_raw" for n in N) + ", reception_us / 1000000.0::DOUBLE)")
ANY_ATTACKED = " OR ".join(f"coalesce({n}_attacked = 'yes', false)" for n in N)


@query("b08_packet_rounding", with_sql(PACKETS_SQL, """
SELECT seq, round(speed_kmh_value, 4) AS speed, round(x, 2) AS x, round(y, 2) AS y FROM pk"""))
def packet_rounding(spark, sf):
    rows = views.packets(spark, sf).select("seq", "speed_kmh", "location")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "seq", P.rounded(F.col("speed_kmh"), kinds["speed_kmh"], 4)["value"].alias("speed"),
        P.rounded(F.col("location"), kinds["location"], 2).alias("l"),
    ).select("seq", "speed", "l.x", "l.y")


@query("b09_drop_raw_timestamp", with_sql(PACKETS_SQL, """
SELECT seq, speed_kmh_value AS speed, speed_kmh_attacked AS attacked, 2 AS fields FROM pk"""))
def drop_raw_timestamp(spark, sf):
    rows = views.packets(spark, sf).withColumns(P.without_raw_times())
    fields = len(rows.schema["speed_kmh"].dataType.fields)
    return rows.select("seq", F.col("speed_kmh.value").alias("speed"),
                       F.col("speed_kmh.attacked").alias("attacked"), F.lit(fields).alias("fields"))


@query("b10_flatten_packet", with_sql(PACKETS_SQL, f"""
SELECT vehicle_id, seq, {", ".join(f"coalesce({n}_value, {n}_scalar, 0.0) AS {n}" for n in N)},
  {BUS_TIME} AS can_time, x AS location_x, coalesce(y, 0.0) AS location_y, 0.0::DOUBLE AS location_z,
  CASE WHEN {ANY_ATTACKED} THEN 'yes' ELSE 'no' END AS attacked FROM pk"""))
def flatten_packet(spark, sf):
    return telemetry.flatten(views.packets(spark, sf))


@query("b11_bus_time", with_sql(PACKETS_SQL, f"SELECT seq, {BUS_TIME} AS bus_time FROM pk"))
def bus_time(spark, sf):
    return views.packets(spark, sf).select("seq", P.bus_time().alias("bus_time"))


@query("b12_latency", with_sql(PACKETS_SQL, f"""
l AS (SELECT seq, reception_us - CAST(round({BUS_TIME} * 1000000) AS BIGINT) AS latency_us FROM pk)""", """
SELECT seq, latency_us, latency_us > 1000000 AS is_slow FROM l"""))
def latency(spark, sf):
    return telemetry.latency(views.packets(spark, sf)).select("seq", "latency_us", "is_slow")


@query("b13_attribute_series", with_sql(PACKETS_SQL, """
SELECT vehicle_id, seq, us, coalesce(brake_value, brake_scalar, 0.0) AS value,
  coalesce(brake_attacked = 'yes', false) AS attacked FROM pk"""))
def attribute_series(spark, sf):
    return telemetry.attribute_series(views.packets(spark, sf), "brake").select(
        "vehicle_id", "seq", F.unix_micros("ts").alias("us"), "value", "attacked")


@query("b14_vehicle_path", with_sql(PACKETS_SQL, """
SELECT vehicle_id, seq, x, y, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS step
FROM pk WHERE x IS NOT NULL AND y IS NOT NULL"""))
def vehicle_path(spark, sf):
    return telemetry.vehicle_path(views.packets(spark, sf)).drop("ts")


@query("b14_current_position", with_sql(PACKETS_SQL, """
SELECT vehicle_id, seq, x, y FROM pk WHERE x IS NOT NULL AND y IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, seq DESC) = 1"""))
def current_position(spark, sf):
    path = views.packets(spark, sf).select("vehicle_id", "ts", "seq", "location.x", "location.y")
    known = path.where("x is not null and y is not null")
    return telemetry.latest_by_key(known, ["seq", "x", "y"])


@query("b25_affected_signals", with_sql(PACKETS_SQL, f"""
SELECT vehicle_id, seq, concat_ws(',', {", ".join(f"CASE WHEN {n}_attacked = 'yes' THEN '{n}' END" for n in N)})
  AS affected FROM pk
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, seq DESC) = 1"""))
def affected_signals(spark, sf):
    return telemetry.affected_signals(views.packets(spark, sf)).withColumn(
        "affected", F.concat_ws(",", "affected"))


@query("e30_packet_counters", with_sql(PACKETS_SQL, """
now AS (SELECT max(reception_us) AS n FROM pk)""", """
SELECT CAST(count(*) AS BIGINT) AS total_packets,
  CAST(count(*) FILTER (reception_us // 600000000 = n // 600000000) AS BIGINT) AS open_packets,
  any_value((n // 600000000 + 1) * 600000000 - n) AS flush_in_us FROM pk, now"""))
def packet_counters(spark, sf):
    return telemetry.packet_counters(views.packets(spark, sf))


@query("j04_flush_intervals", with_sql(PACKETS_SQL, """
SELECT vehicle_id, us // 600000000 * 600000000 AS start_us, count(*) AS packets FROM pk GROUP BY 1, 2"""))
def flush_intervals(spark, sf):
    return telemetry.flush_intervals(views.packets(spark, sf))


@query("g08_latest_packet", with_sql(PACKETS_SQL, """
SELECT vehicle_id, seq, us, speed_kmh_value AS speed FROM pk ORDER BY ts DESC, seq DESC LIMIT 1"""))
def latest_packet(spark, sf):
    rows = views.packets(spark, sf).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(1)
    return rows.select("vehicle_id", "seq", F.unix_micros("ts").alias("us"),
                       F.col("speed_kmh.value").alias("speed"))


def packet_lines(spark, sf):
    """The packets as JSON text, legacy scalars included."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(
        F.when(F.col(f"{column}_scalar").isNotNull(), F.col(f"{column}_scalar").cast("string")),
        F.to_json(column))) for name, column in PACKET_SIGNALS.items()]
    place = F.concat(F.lit('"Location": '), F.to_json("location"))
    return views.packets(spark, sf).select(
        "seq", F.concat(F.lit("{"), F.concat_ws(", ", *parts, place), F.lit("}")).alias("value"))


@query("a05_packet_text_parse", with_sql(PACKETS_SQL, f"""
SELECT seq, {", ".join(f"coalesce({n}_scalar, {n}_value, 0.0) AS {n}, CASE WHEN {n}_scalar IS NULL THEN {n}_attacked END AS {n}_attacked" for n in N)}, x, y FROM pk"""))
def packet_text_parse(spark, sf):
    rows = readers.parse_packets(packet_lines(spark, sf))
    return rows.select(
        "seq", *[P.signal_value(n).alias(n) for n in N],
        *[F.col(f"{n}.attacked").alias(f"{n}_attacked") for n in N], "location.x", "location.y")


@query("b08_published_packet", with_sql(PACKETS_SQL, """
SELECT seq, round(brake_value, 4) AS brake, brake_attacked, round(x, 2) AS x, false AS has_raw FROM pk"""))
def published_packet(spark, sf):
    rows = views.packets(spark, sf)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    sent = rows.select("seq", P.published(kinds).alias("value"))
    back = readers.parse_packets(sent)
    return back.select(
        "seq", F.col("brake.value").alias("brake"), F.col("brake.attacked").alias("brake_attacked"),
        "location.x", F.contains("value", F.lit("raw_timestamp")).alias("has_raw"))
