"""Bus frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.functions import frames as B
from vigilbus.operators import frames as ops
from vigilbus.queries.registry import query, with_sql
from vigilbus.sources import views
from vigilbus.sources.views import FRAMES_SQL

BIG = "substr(hexdata, 1, 8)"
LITTLE = "substr(hexdata,7,2) || substr(hexdata,5,2) || substr(hexdata,3,2) || substr(hexdata,1,2)"


def _words(expr: str) -> str:
    return (f"w AS (SELECT *, CASE WHEN length(hexdata) >= 8 THEN CAST('0x' || {expr} AS BIGINT) END AS w FROM fr)")


FLOAT = """CASE WHEN w IS NULL OR (w // 8388608) % 256 = 255 THEN NULL ELSE
  (CASE WHEN w >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) *
  CASE WHEN (w // 8388608) % 256 = 0 THEN (w % 8388608) * pow(2.0::DOUBLE, -149)
  ELSE (1 + (w % 8388608) / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, (w // 8388608) % 256 - 127) END END"""
INT = "CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END"
VALUE = f"CASE WHEN kind = 'i32' THEN CAST({INT} AS DOUBLE) ELSE {FLOAT} END"
NON_FINITE = "(coalesce((w // 8388608) % 256 = 255, false))"


def finite(x):
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _decoded(spark, sf, endian):
    words = views.frames(spark, sf).select("seq", B.word(F.col("data"), endian).alias("w"))
    x = F.col("x")
    return words.select("seq", "w", B.float_of(F.col("w")).alias("x")).select(
        "seq", finite(x).alias("float_value"),
        F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)).alias("non_finite"),
        B.int_of(F.col("w")).alias("int_value"))


@query("b01_b02_decode_big_endian", with_sql(FRAMES_SQL, _words(BIG), f"""
SELECT seq, {FLOAT} AS float_value, {NON_FINITE} AS non_finite, {INT} AS int_value FROM w"""))
def decode_big_endian(spark, sf):
    return _decoded(spark, sf, "big")


@query("b03_decode_little_endian", with_sql(FRAMES_SQL, _words(LITTLE), f"""
SELECT seq, {FLOAT} AS float_value, {NON_FINITE} AS non_finite, {INT} AS int_value FROM w"""))
def decode_little_endian(spark, sf):
    return _decoded(spark, sf, "little")


SIGNATURE = "(length(hexdata) > 0 AND CAST('0x0' || right(hexdata, 2) AS BIGINT) >= 128)"


@query("b04_signature_flag", with_sql(FRAMES_SQL, f"SELECT seq, {SIGNATURE} AS signature_flag FROM fr"))
def signature_flag(spark, sf):
    return views.frames(spark, sf).select(
        "seq", B.signature_flag(F.col("data")).alias("signature_flag"))


@query("c06_data_frames", with_sql(FRAMES_SQL, """
SELECT seq, arbitration_id FROM fr WHERE NOT is_error AND NOT is_remote"""))
def data_frames(spark, sf):
    return ops.data_frames(views.frames(spark, sf)).select("seq", "arbitration_id")


@query("c07_unmapped_counts", with_sql(FRAMES_SQL, """
SELECT arbitration_id, count(*) AS n FROM fr WHERE NOT is_error AND NOT is_remote
  AND arbitration_id % 256 NOT IN (SELECT code FROM dim) GROUP BY 1"""))
def unmapped_counts(spark, sf):
    frames = ops.data_frames(views.frames(spark, sf))
    return ops.id_counts(ops.unmapped(frames, views.signal_dim(spark)))


@query("c08_unmarked_frames", with_sql(FRAMES_SQL, f"SELECT seq FROM fr WHERE NOT {SIGNATURE}"))
def unmarked_frames(spark, sf):
    return ops.unmarked(views.frames(spark, sf)).select("seq")


@query("d01_signal_lookup", with_sql(FRAMES_SQL, f"""
SELECT vehicle_id, seq, signal, {SIGNATURE} AS signature_flag, length(hexdata) >= 8 AS decodable
FROM fr JOIN dim ON arbitration_id % 256 = code WHERE NOT is_error AND NOT is_remote"""))
def signal_lookup(spark, sf):
    frames = ops.data_frames(views.frames(spark, sf))
    return ops.map_signals(frames, views.signal_dim(spark)).select(
        "vehicle_id", "seq", "signal", B.signature_flag(F.col("data")).alias("signature_flag"),
        (F.length("data") >= 4).alias("decodable"))


@query("decode_frames_to_signals", with_sql(FRAMES_SQL, _words(BIG), f"""
SELECT vehicle_id, seq, signal, {VALUE} AS value FROM w JOIN dim ON arbitration_id % 256 = code
WHERE NOT is_error AND NOT is_remote"""))
def decode_to_signals(spark, sf):
    rows = ops.decode_signals(views.frames(spark, sf), views.signal_dim(spark))
    return rows.select("vehicle_id", "seq", "signal", finite(F.col("value")).alias("value"))


@query("e01_capture_summary", with_sql(FRAMES_SQL, """
SELECT count(*) AS frames, count(DISTINCT arbitration_id) AS distinct_ids FROM fr"""))
def capture_summary(spark, sf):
    return ops.capture_summary(views.frames(spark, sf))


@query("e01_frames_per_id", with_sql(FRAMES_SQL, "SELECT arbitration_id, count(*) AS n FROM fr GROUP BY 1"))
def frames_per_id(spark, sf):
    return ops.id_counts(views.frames(spark, sf))


@query("e06_bus_health", with_sql(FRAMES_SQL, """
SELECT count(*) FILTER (is_error) AS error_frames, count(*) FILTER (is_remote) AS remote_frames,
  count(*) FILTER (NOT is_error AND NOT is_remote AND arbitration_id % 256 NOT IN (SELECT code FROM dim))
  AS unmapped_frames FROM fr"""))
def bus_health(spark, sf):
    return ops.bus_health(views.frames(spark, sf), views.signal_dim(spark))


@query("e07_frames_per_second", with_sql(FRAMES_SQL, """
SELECT vehicle_id, us // 30000000 * 30000000 AS start_us, count(*) / 30.0::DOUBLE AS fps FROM fr GROUP BY 1, 2"""))
def frames_per_second(spark, sf):
    return ops.frames_per_second(views.frames(spark, sf))


@query("g01_top_unmapped", with_sql(FRAMES_SQL, """
SELECT arbitration_id, count(*) AS n FROM fr WHERE NOT is_error AND NOT is_remote
  AND arbitration_id % 256 NOT IN (SELECT code FROM dim) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"""))
def top_unmapped(spark, sf):
    return ops.top_unmapped(views.frames(spark, sf), views.signal_dim(spark))


REPLAY_SQL = with_sql(FRAMES_SQL, _words(BIG), f"""
n AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) % 2 = 1 AS up, {VALUE} AS plain,
  CAST(length(hexdata) // 2 AS INTEGER) AS size FROM w LEFT JOIN dim ON arbitration_id % 256 = code)""", """
s AS (SELECT *, CASE WHEN signal IS NULL AND size >= 4 THEN
   list_aggregate(list_transform(range(size), lambda i: printf('%02x', CAST(CASE WHEN up
      THEN least(255, 2 * CAST('0x0' || substr(hexdata, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))
      ELSE CAST('0x0' || substr(hexdata, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) // 2 END AS BIGINT))), 'string_agg', '')
   ELSE hexdata END AS h FROM n)""", """
SELECT seq, CASE WHEN up THEN 'increase' ELSE 'decrease' END AS modification,
  CASE WHEN plain IS NULL THEN NULL WHEN kind = 'i32' THEN CASE WHEN up THEN least(6.0::DOUBLE, plain + 1) ELSE greatest(-1.0::DOUBLE, plain - 1) END
    WHEN signal IS NOT NULL THEN plain * CASE WHEN up THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END END AS value,
  CASE WHEN size = 0 THEN '' ELSE left(h, CAST(2 * size - 2 AS BIGINT)) || printf('%02x',
    CAST('0x0' || right(h, 2) AS BIGINT) | 128) END AS payload FROM s""")


@query("k10_modified_replay", REPLAY_SQL)
def modified_replay(spark, sf):
    out = ops.modified_replay(views.frames(spark, sf), views.signal_dim(spark))
    return out.select("seq", "modification", finite(F.col("value")).alias("value"),
                      F.lower(F.hex("data")).alias("payload"))


@query("e02_injected_counts", with_sql(FRAMES_SQL, """
n AS (SELECT arbitration_id, CASE WHEN row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, seq) % 2 = 1 THEN 'increase' ELSE 'decrease' END
  AS modification FROM fr)""", "SELECT arbitration_id, modification, count(*) AS n FROM n GROUP BY 1, 2"))
def injected_counts(spark, sf):
    out = ops.modified_replay(views.frames(spark, sf), views.signal_dim(spark))
    return out.groupBy("arbitration_id", "modification").agg(F.count(F.lit(1)).alias("n"))
