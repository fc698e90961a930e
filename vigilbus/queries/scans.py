"""Scans, alias resolution, text feeds and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.functions import text
from vigilbus.queries.registry import query, with_sql
from vigilbus.sources import readers, views
from vigilbus.sources.views import ATTACK_LOG_SQL, SIGNALS_SQL


@query("a01_recursive_parquet_scan", """
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 2) AS sum_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def recursive_parquet_scan(spark, sf):
    rows = readers.load_parquet(spark, f"{sf}/lineitem.parquet")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("sum_quantity"))


@query("a02_alias_resolution", """
SELECT l_orderkey, l_linenumber, l_quantity AS speed_kmh, l_extendedprice AS battery_level FROM lineitem""")
def alias_resolution(spark, sf):
    raw = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("SPEED"),
        F.col("l_extendedprice").alias("Soc"), "l_tax")
    wanted = {"speed_kmh": ["speed_kmh", "speed"], "battery_level": ["battery_level", "battery", "soc"]}
    return readers.resolve_aliases(raw, wanted, keep=["l_orderkey", "l_linenumber"])


@query("a03_schema_check", "SELECT event_id, user_id, value FROM events")
def schema_check(spark, sf):
    wanted = ["event_id", "user_id", "value"]
    return readers.require_columns(views.table(spark, sf, "events"), wanted).select(*wanted)


@query("a07_location_feed", with_sql(SIGNALS_SQL, """
SELECT seq, value AS x, CAST(k AS DOUBLE) AS y, 0.5::DOUBLE AS z FROM sig WHERE k % 3 <> 0 AND k % 7 <> 0"""))
def location_feed(spark, sf):
    k = F.col("k")
    lines = views.signals(spark, sf).select("seq", F.concat(
        F.lit(" "), F.col("value").cast("string"), F.lit(","), k.cast("string"),
        F.when(k % 3 == 0, "").when(k % 7 == 0, ",n/a").otherwise(",0.5 ")).alias("line"))
    return readers.parse_location(lines, "line").drop("line")


@query("a07_location_feed_two_parts", with_sql(SIGNALS_SQL, """
SELECT seq, value AS x, CAST(k AS DOUBLE) AS y FROM sig"""))
def location_feed_two_parts(spark, sf):
    k = F.col("k")
    lines = views.signals(spark, sf).select("seq", F.concat_ws(
        ",", F.col("value").cast("string"), k.cast("string"), F.when(k % 2 == 0, "9.0"))
        .alias("line"))
    return readers.parse_location(lines, "line", parts=2, exact=False).drop("line")


@query("a08_signal_feed", with_sql(SIGNALS_SQL, """
SELECT seq, signal, value AS signal_value FROM sig WHERE k % 9 <> 0"""))
def signal_feed(spark, sf):
    body = F.to_json(F.struct("signal", "value"))
    lines = views.signals(spark, sf).select(
        "seq", F.when(F.col("k") % 9 == 0, "{broken").otherwise(body).alias("line"))
    return readers.parse_signal_json(lines, "line").drop("line")


@query("a10_attack_log", with_sql(SIGNALS_SQL, ATTACK_LOG_SQL, """
SELECT vehicle_id, attack_type, start_us, end_us, trigger_type FROM atk"""))
def attack_log(spark, sf):
    return views.attack_log(spark, sf).select(
        "vehicle_id", "attack_type", F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("end_time").alias("end_us"), "trigger_type")


@query("b05_vehicle_id_split", with_sql(SIGNALS_SQL, """
f AS (SELECT seq, vehicle_id * 256 + 35 + k % 6 AS arbitration_id FROM sig)""", """
SELECT seq, arbitration_id, CAST(arbitration_id // 256 AS BIGINT) AS edge, CAST(arbitration_id % 256 AS BIGINT) AS code FROM f"""))
def vehicle_id_split(spark, sf):
    frames = views.signals(spark, sf).select(
        "seq", (F.col("vehicle_id") * 256 + 35 + F.col("k") % 6).alias("arbitration_id"))
    return frames.withColumns({
        "edge": F.expr("arbitration_id div 256"), "code": F.expr("arbitration_id % 256")})


@query("b06_edge_number", """
SELECT doc_id, coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN lang ELSE
  CAST(doc_id % 100 AS VARCHAR) END AS INTEGER), 1) AS edge FROM documents""")
def edge_number(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("_", F.lit("edge"), F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
                              .otherwise((F.col("doc_id") % 100).cast("string"))).alias("client"))
    return docs.select("doc_id", text.edge_number(F.col("client")).alias("edge"))


@query("b07_hex_and_millis", with_sql(SIGNALS_SQL, """
SELECT seq, '0x' || printf('%x', vehicle_id * 256 + 35) AS id_text,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts_text FROM sig"""))
def hex_and_millis(spark, sf):
    return views.signals(spark, sf).select(
        "seq", text.hex_id(F.col("vehicle_id") * 256 + 35).alias("id_text"),
        text.iso_millis(F.col("ts")).alias("ts_text"))


@query("h01_union_of_files", """
SELECT 'orders' AS origin, count(*) AS n, round(sum(o_totalprice), 2) AS total, 0 AS n_with_tax FROM orders
UNION ALL SELECT 'lineitem', count(*), round(sum(l_extendedprice), 2), count(l_tax) FROM lineitem""")
def union_of_files(spark, sf):
    orders = views.table(spark, sf, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_totalprice").alias("price"))
    items = views.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("origin"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"))
    return readers.union_all([orders, items]).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"),
        F.count("tax").alias("n_with_tax"))


@query("c09_non_finite_to_zero", with_sql(SIGNALS_SQL, """
SELECT seq, CASE WHEN k % 5 < 4 THEN 0.0 ELSE value END AS clean FROM sig"""))
def non_finite_to_zero(spark, sf):
    k = F.col("k") % 5
    dirty = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(
        k == 2, float("-inf")).when(k == 4, F.col("value"))
    return views.signals(spark, sf).select("seq", readers.clean_number(dirty).alias("clean"))
