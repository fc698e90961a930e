"""Scalers and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilbus.operators import evaluate, scaling, windows
from vigilbus.queries.registry import query, with_sql
from vigilbus.schema import WINDOW_FEATURES
from vigilbus.session import ensure_checkpoint_dir
from vigilbus.sources import views
from vigilbus.sources.views import SIGNALS_SQL, TELEMETRY_SQL

ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
N = len(WINDOW_FEATURES)


def checksum(w="w", features=N):
    """Position-weighted sum of a window, so that order and every cell count."""
    weighted = F.transform(F.flatten(w), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4).alias("checksum")


def step_sum(offset: str, alias: str = "b", features=WINDOW_FEATURES) -> str:
    """SQL twin of one step of :func:`checksum`."""
    return " + ".join(
        f"({offset} * {len(features)} + {i + 1}) * {alias}.{f}" for i, f in enumerate(features))


NUMBERED_SQL = TELEMETRY_SQL + """, num AS (
  SELECT *, row_number() OVER v AS rn, count(*) OVER (PARTITION BY vehicle_id) AS n
  FROM tel WINDOW v AS (PARTITION BY vehicle_id ORDER BY ts, seq))"""


def window_sql(where: str, extra: str = "", number: str = "a.rn") -> str:
    return with_sql(NUMBERED_SQL, f"""
SELECT a.vehicle_id, a.seq AS start_seq, max(b.seq) AS end_seq, {number} AS number,
  round(sum({step_sum("(b.rn - a.rn)")}), 4) AS checksum{extra}
FROM num a JOIN num b ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn AND a.rn + 19
WHERE a.rn + 19 <= a.n AND {where} GROUP BY a.vehicle_id, a.seq, a.rn""")


def _out(rows, *extra):
    return rows.select("vehicle_id", "start_seq", "end_seq", "number", checksum(), *extra)


@query("f08_sliding_windows", window_sql("true"))
def sliding_windows(spark, sf):
    return _out(windows.sliding(views.telemetry(spark, sf)))


@query("f08_sliding_windows_stride_5", window_sql("(a.rn - 1) % 5 = 0", number="(a.rn - 1) // 5 + 1"))
def sliding_windows_stride(spark, sf):
    return _out(windows.sliding(views.telemetry(spark, sf), stride=5))


@query("f09_training_windows", window_sql(
    "(a.rn - 1) % 20 = 0 AND a.rn + 20 <= a.n AND (a.rn - 1) // 20 < 400",
    number="(a.rn - 1) // 20 + 1"))
def training_windows(spark, sf):
    return _out(windows.training(views.telemetry(spark, sf), cap=400))


@query("f11_window_labels", window_sql("true", ", max(CAST(b.attacked AS INTEGER)) AS label"))
def window_labels(spark, sf):
    return _out(windows.sliding(views.telemetry(spark, sf), label="attacked"), "label")


def _short_sql(first: bool) -> str:
    """Series of one signal are shorter than a window; the padding stands in front."""
    head = "coalesce(max((20 - n) * (21 - n) / 2 * value) FILTER (rn = 1), 0) + " if first else ""
    return with_sql(SIGNALS_SQL, """
s AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, signal ORDER BY ts, seq) AS rn,
  count(*) OVER (PARTITION BY vehicle_id, signal) AS n FROM sig)""", f"""
SELECT vehicle_id, signal, count(*) AS "rows", round({head}sum((20 - n + rn) * value), 4) AS checksum
FROM s WHERE n < 20 GROUP BY vehicle_id, signal""")


def _padded(spark, sf, padding):
    out = windows.padded_short(
        views.signals(spark, sf), ["value"], padding=padding, key=["vehicle_id", "signal"])
    return out.select("vehicle_id", "signal", F.col("rows").cast("long").alias("rows"), checksum())


@query("f10_padded_with_zeros", _short_sql(False))
def padded_with_zeros(spark, sf):
    return _padded(spark, sf, "zero")


@query("f10_padded_with_first_row", _short_sql(True))
def padded_with_first(spark, sf):
    return _padded(spark, sf, "first")


@query("f12_latest_window", with_sql(NUMBERED_SQL, f"""
SELECT vehicle_id, max(seq) FILTER (rn = n) AS end_seq, count(*) AS "rows",
  CASE WHEN count(*) = 20 THEN round(sum({step_sum("(19 - n + rn)", "num")}), 4) END AS checksum
FROM num WHERE rn > n - 20 GROUP BY vehicle_id"""))
def latest_window(spark, sf):
    return windows.latest(views.telemetry(spark, sf)).select(
        "vehicle_id", "end_seq", F.col("rows").cast("long").alias("rows"), checksum())


@query("b18_flatten_and_reshape", window_sql("true"))
def flatten_and_reshape(spark, sf):
    rows = windows.sliding(views.telemetry(spark, sf))
    return _out(rows.withColumn("w", windows.unflat(windows.flat(F.col("w")))))


def _stats_sql(columns, table):
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, "
        f"round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {table}"
        for c in columns)


@query("e08_feature_stats", _stats_sql(ITEM_FEATURES, "lineitem"))
def feature_stats(spark, sf):
    s = scaling.feature_stats(views.table(spark, sf, "lineitem"), ITEM_FEATURES)
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


CONST_ITEMS = "(SELECT *, 7.0::DOUBLE AS constant FROM lineitem)"


def _items(spark, sf):
    return views.table(spark, sf, "lineitem").withColumn("constant", F.lit(7.0))


FIT_COLUMNS = ["l_quantity", "l_tax", "constant"]


@query("e09_zscore_fit", "SELECT feature, round(mean, 6) AS \"offset\", round(CASE WHEN std > 1e-6 THEN std ELSE 1.0 END, 6) AS scale,"
       " n >= 50 AS fitted FROM (" + _stats_sql(FIT_COLUMNS, CONST_ITEMS) + ")")
def zscore_fit(spark, sf):
    s = scaling.zscore_fit(_items(spark, sf), FIT_COLUMNS)
    return s.select("feature", F.round("offset", 6).alias("offset"),
                    F.round("scale", 6).alias("scale"), "fitted")


@query("e10_minmax_fit", "SELECT feature, min AS \"offset\", CASE WHEN max > min THEN max - min ELSE 1.0 END AS scale"
       " FROM (" + _stats_sql(FIT_COLUMNS, CONST_ITEMS) + ")")
def minmax_fit(spark, sf):
    return scaling.minmax_fit(_items(spark, sf), FIT_COLUMNS).select("feature", "offset", "scale")


ITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(ITEM_KEY)


@query("b19_zscore_apply", f"""
SELECT {KEY_SQL}, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) /
  (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity, 0.0::DOUBLE AS constant FROM lineitem""")
def zscore_apply(spark, sf):
    rows = _items(spark, sf).select(*ITEM_KEY, "l_quantity", "constant")
    fitted = scaling.constants(scaling.zscore_fit(rows, ["l_quantity", "constant"]))
    return scaling.apply(rows, fitted).withColumn("l_quantity", F.round("l_quantity", 6))


@query("b19_zscore_inverse", f"SELECT {KEY_SQL}, round(l_quantity, 6) AS l_quantity FROM lineitem")
def zscore_inverse(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_quantity")
    fitted = scaling.constants(scaling.zscore_fit(rows, ["l_quantity"]))
    return scaling.invert(scaling.apply(rows, fitted), fitted).withColumn(
        "l_quantity", F.round("l_quantity", 6))


@query("b20_minmax_apply", f"""
SELECT {KEY_SQL}, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) /
  (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice FROM lineitem""")
def minmax_apply(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_extendedprice")
    fitted = scaling.constants(scaling.minmax_fit(rows, ["l_extendedprice"]))
    return scaling.apply(rows, fitted).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("b20_minmax_inverse", f"SELECT {KEY_SQL}, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem")
def minmax_inverse(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_extendedprice")
    fitted = scaling.constants(scaling.minmax_fit(rows, ["l_extendedprice"]))
    return scaling.invert(scaling.apply(rows, fitted), fitted).withColumn(
        "l_extendedprice", F.round("l_extendedprice", 4))


@query("b19_zscore_per_vehicle", with_sql(TELEMETRY_SQL, """
SELECT vehicle_id, seq, round((brake - avg(brake) OVER v) / CASE WHEN stddev_pop(brake) OVER v > 1e-6
  THEN stddev_pop(brake) OVER v ELSE 1.0 END, 6) AS brake FROM tel WINDOW v AS (PARTITION BY vehicle_id)"""))
def zscore_per_vehicle(spark, sf):
    rows = views.telemetry(spark, sf).select("vehicle_id", "seq", "brake")
    scaler = scaling.zscore_fit(rows, ["brake"], ["vehicle_id"])
    return scaling.apply_by(rows, scaler, ["vehicle_id"]).withColumn("brake", F.round("brake", 6))


@query("a16_scaler_save_load", f"""
SELECT {KEY_SQL}, round((l_tax - (SELECT min(l_tax) FROM lineitem)) /
  (SELECT max(l_tax) - min(l_tax) FROM lineitem), 6) AS l_tax FROM lineitem""")
def scaler_save_load(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_tax")
    path = f"{ensure_checkpoint_dir(spark)}/scaler-{uuid.uuid4().hex}"
    scaling.save(scaling.minmax_fit(rows, ["l_tax"]), path)
    fitted = scaling.constants(scaling.load(spark, path))
    return scaling.apply(rows, fitted).withColumn("l_tax", F.round("l_tax", 6))


ALARM = 1.2


@query("b21_explain_window", with_sql(NUMBERED_SQL, """
st AS (SELECT avg(speed_kmh) AS m1, stddev_pop(speed_kmh) AS s1, avg(brake) AS m2, stddev_pop(brake) AS s2 FROM tel)""", """
z AS (SELECT vehicle_id, seq, rn, n, (speed_kmh - m1) / s1 AS z1, (brake - m2) / s2 AS z2, speed_kmh, brake FROM num, st)""", f"""
hot AS (SELECT a.vehicle_id, a.rn, a.seq AS start_seq FROM z a JOIN z b ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn AND a.rn + 19
  WHERE a.rn + 19 <= a.n GROUP BY ALL HAVING avg((b.z1 * b.z1 + b.z2 * b.z2) / 2) > {ALARM})""", """
SELECT vehicle_id, start_seq, CAST(z.rn - hot.rn AS INTEGER) AS step, round(z1, 6) AS speed_kmh_z, round(speed_kmh, 6) AS speed_kmh,
  round(z2, 6) AS brake_z, round(brake, 6) AS brake FROM hot JOIN z USING (vehicle_id) WHERE z.rn BETWEEN hot.rn AND hot.rn + 19"""))
def explain_window(spark, sf):
    """Every window whose mean square is above the alarm threshold."""
    names = ["speed_kmh", "brake"]
    rows = views.telemetry(spark, sf)
    fitted = scaling.constants(scaling.zscore_fit(rows, names))
    scored = windows.sliding(scaling.apply(rows, fitted), names)
    hot = scored.where(evaluate.mean_square(F.col("w")) > ALARM)
    out = windows.explain(hot, fitted, names, ["vehicle_id", "start_seq"])
    return out.withColumns({c: F.round(c, 6) for c in ("speed_kmh_z", "speed_kmh", "brake_z", "brake")})


@query("g03_uniform_sample", with_sql(SIGNALS_SQL, """
r AS (SELECT seq, value, row_number() OVER (ORDER BY ts, seq) - 1 AS p, count(*) OVER () AS n FROM sig)""", """
SELECT seq, value FROM r WHERE p IN (SELECT (i * (n - 1)) // 199 FROM (SELECT unnest(range(200)) AS i), (SELECT any_value(n) AS n FROM r))"""))
def uniform_sample(spark, sf):
    return windows.uniform_sample(views.signals(spark, sf), 200, ["ts", "seq"]).select("seq", "value")


@query("g04_sequential_split", with_sql(SIGNALS_SQL, """
SELECT seq, row_number() OVER (ORDER BY ts, seq) <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train FROM sig"""))
def sequential_split(spark, sf):
    rows = views.signals(spark, sf).select("ts", "seq")
    return windows.sequential_split(rows, 0.8, ["ts", "seq"]).select("seq", "is_train")


@query("g06_random_batches", with_sql(SIGNALS_SQL, """
SELECT seq, (row_number() OVER (ORDER BY md5('42|' || seq), seq) - 1) // 32 AS batch FROM sig"""))
def random_batches(spark, sf):
    return windows.batches(views.signals(spark, sf).select("seq"), 42, ["seq"], 32)


@query("g07_random_windows", with_sql(NUMBERED_SQL, """
SELECT vehicle_id, seq AS start_seq FROM num WHERE rn + 19 <= n AND (rn - 1) % 20 = 0
ORDER BY md5('7|' || vehicle_id || '|' || seq), vehicle_id, seq LIMIT 25"""))
def random_windows(spark, sf):
    rows = windows.sliding(views.telemetry(spark, sf), stride=20).select("vehicle_id", "start_seq")
    return windows.random_sample(rows, 25, 7, ["vehicle_id", "start_seq"])
