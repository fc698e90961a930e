"""Streaming queries: each drains a stream over the given tables and reads its sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.models import nets

from vigilbus.queries.federated import SEND_SQL
from vigilbus.queries.registry import query, with_sql
from vigilbus.queries.signals import LOCATION_SQL, location_feed
from vigilbus.queries.windows import NUMBERED_SQL

from vigilbus.sources import readers, views
from vigilbus.sources.views import FRAMES_SQL, PACKETS_SQL, SIGNALS_SQL, WEIGHTS_SQL
from vigilbus.streaming import batches, joins, sinks, sources, stateful, thresholds, windowed

HOUR = 3_600_000_000
DAY = 24 * HOUR
WINDOW_KEY = ["vehicle_id", "start_us"]


def event_stream(spark, sf, per_trigger=None):
    """The signals view as a stream over the events file."""
    schema = views.table(spark, sf, "events").schema
    return _signals(sources.table(spark, sf, "events", schema, per_trigger))


def event_table(spark, sf):
    return _signals(views.table(spark, sf, "events"))


def _signals(raw):
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("vehicle_id"), F.col("event_id").alias("seq"),
        views._event_case(1).alias("signal"), "value",
        views.payload().alias("k"))


@query("j01_stream_rate_windows", with_sql(SIGNALS_SQL, f"""
w AS (SELECT vehicle_id, us // {HOUR} * {HOUR} - o * {HOUR} AS start_us FROM sig, (SELECT unnest(range(6)) AS o))""", f"""
SELECT vehicle_id, start_us, count(*) AS messages FROM w GROUP BY 1, 2"""))
def stream_rate_windows(spark, sf):
    stream = event_stream(spark, sf).select("ts", "vehicle_id")
    out = windowed.rate_windows(stream, ["vehicle_id"], "6 hours", "1 hour", "1 day")
    return sinks.finish_newest(out, "rate", WINDOW_KEY)


RATE_SQL = with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, signal, seq, count(*) OVER (PARTITION BY vehicle_id, signal ORDER BY us
  RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS rate FROM sig""")


@query("j01_stream_exact_rate", RATE_SQL)
def stream_exact_rate(spark, sf):
    stream = event_stream(spark, sf).select("vehicle_id", "signal", "us", "seq")
    return sinks.finish(stateful.exact_rate(stream, 6 * HOUR, block_us=64 * DAY), "exact")


def _by_batches(rows, step, name, schema, landings=5):
    """Land the rows in order of time, a share at a time; each landing is a micro-batch.

    The query is restarted from its checkpoint for every landing.
    """
    spark = rows.sparkSession
    folder = sinks.scratch(spark, name)
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    share = ((high or 0) - (low or 0)) // landings + 1
    for i in range(landings):
        rows.where(F.floor((F.col("us") - F.lit(low)) / share) == i).write.mode("append").parquet(
            f"{folder}/landed")
        stream = sources.files(spark, f"{folder}/landed", rows.schema, files_per_trigger=1_000_000)
        batches.follow(stream, step, folder).awaitTermination()
    return batches.results(spark, folder, schema)


@query("j01_batches_exact_rate", RATE_SQL)
def batches_exact_rate(spark, sf):
    rows = event_table(spark, sf).select("ts", "us", "vehicle_id", "signal", "seq")
    return _by_batches(rows, batches.exact_rate(6 * HOUR), "rates",
                       "vehicle_id long, signal string, seq long, rate long")


CHANGED_SQL = with_sql(SIGNALS_SQL, """
st AS (SELECT vehicle_id, seq, ts, """ + ", ".join(
    f"coalesce(last_value(CASE WHEN signal = '{n}' THEN value END IGNORE NULLS) OVER w, {d}) AS {n}"
    for n, d in (("speed_kmh", 0.0), ("battery_level", 85.0), ("brake", 0.0))) + """
  FROM sig WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))""", """
SELECT vehicle_id, seq, speed_kmh, battery_level, brake FROM st
WINDOW v AS (PARTITION BY vehicle_id ORDER BY ts, seq)
QUALIFY row_number() OVER v = 1 OR speed_kmh <> lag(speed_kmh) OVER v OR battery_level <> lag(battery_level) OVER v OR brake <> lag(brake) OVER v""")
CHANGED_DEFAULTS = {"speed_kmh": 0.0, "battery_level": 85.0, "brake": 0.0}


@query("j02_stream_changed_state", CHANGED_SQL)
def stream_changed_state(spark, sf):
    stream = event_stream(spark, sf).select("vehicle_id", "us", "seq", "signal", "value")
    return sinks.finish(stateful.changed_state(stream, CHANGED_DEFAULTS), "changed")


@query("j02_batches_changed_state", CHANGED_SQL)
def batches_changed_state(spark, sf):
    rows = event_table(spark, sf).select("ts", "us", "vehicle_id", "seq", "signal", "value")
    return _by_batches(rows, batches.changed_state(CHANGED_DEFAULTS), "changes",
                       "vehicle_id long, seq long, speed_kmh double, battery_level double, brake double")


@query("j03_stream_state_grid", with_sql(SIGNALS_SQL, """
st AS (SELECT vehicle_id, us, seq, """ + ", ".join(
    f"coalesce(last_value(CASE WHEN signal = '{n}' THEN value END IGNORE NULLS) OVER w, 0.0) AS {n}"
    for n in ("speed_kmh", "brake")) + f"""
  FROM sig WINDOW w AS (PARTITION BY vehicle_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
nxt AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY vehicle_id ORDER BY us, seq),
  (SELECT max(us) // 1000 * 1000 FROM sig)) - 1 AS until_us FROM st),
pts AS (SELECT vehicle_id, speed_kmh, brake, unnest(range((us + {6 * HOUR} - 1) // {6 * HOUR},
  until_us // {6 * HOUR} + 1)) AS p FROM nxt)""", f"""
SELECT vehicle_id, p * {6 * HOUR} AS grid_us, speed_kmh, brake FROM pts"""))
def stream_state_grid(spark, sf):
    stream = event_stream(spark, sf).select("ts", "vehicle_id", "us", "seq", "signal", "value")
    return sinks.finish(stateful.state_grid(
        stream, 6 * HOUR, "0 seconds", {"speed_kmh": 0.0, "brake": 0.0}), "grid")


@query("j03_stream_sampled_state", with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, us // {6 * HOUR} * {6 * HOUR} AS start_us, arg_max(seq, (us, seq)) AS seq, arg_max(value, (us, seq)) AS value
FROM sig GROUP BY 1, 2"""))
def stream_sampled_state(spark, sf):
    stream = event_stream(spark, sf).select("ts", "vehicle_id", "seq", "value")
    out = windowed.sampled_state(stream, ["value"], "6 hours", "1 day")
    return sinks.finish_newest(out, "sampled", WINDOW_KEY)


@query("j04_stream_flush_intervals", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, us // 600000000 * 600000000 AS start_us, count(*) AS messages FROM sig GROUP BY 1, 2"""))
def stream_flush_intervals(spark, sf):
    stream = event_stream(spark, sf).select("ts", "vehicle_id")
    out = windowed.rate_windows(stream, ["vehicle_id"], "600 seconds", "600 seconds", "1 day")
    return sinks.finish_newest(out, "flush", WINDOW_KEY)


@query("j05_stream_status_summary", with_sql(SIGNALS_SQL, f"""
SELECT vehicle_id, us // {DAY} * {DAY} AS start_us, count(*) AS "rows", count(*) FILTER (k >= 90) AS flagged, min(value) AS low, max(value) AS high
FROM sig GROUP BY 1, 2"""))
def stream_status_summary(spark, sf):
    stream = event_stream(spark, sf).select("ts", "vehicle_id", "value", "k")
    out = windowed.status_summary(stream, "1 day", "1 day", F.col("k") >= 90)
    return sinks.finish_newest(out, "status", WINDOW_KEY)


@query("j07_stream_without_resends", with_sql(SIGNALS_SQL, "SELECT vehicle_id, seq, us, value FROM sig"))
def stream_without_resends(spark, sf):
    rows = event_stream(spark, sf).select("ts", "vehicle_id", "seq", "us", "value")
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return sinks.finish(
        windowed.without_resends(doubled, ["vehicle_id", "seq"], "1 day").drop("ts"), "resend")


def _stream_windows(spark, sf):
    rows = event_stream(spark, sf)
    vector = F.array("value", F.col("k").cast("double"))
    return stateful.online_windows(rows.select("vehicle_id", "us", "seq", vector.alias("v")), 2)


FAR_US = 4_102_444_800_000_000  # the year 2100


def _closed_stream(rows, name, times):
    """Rows that landed in a folder, as a stream; a last row far ahead closes all event times."""
    spark = rows.sparkSession
    folder = sinks.scratch(spark, name)
    rows.write.parquet(folder)
    fill = {"vehicle_id": F.lit(-1), "seq": F.lit(-1), **{t: F.timestamp_micros(F.lit(FAR_US + i))
                                                         for i, t in enumerate(times)}, "us": F.lit(FAR_US)}
    spark.range(1).select(*[fill.get(c, F.lit(None)).cast(k).alias(c) for c, k in rows.dtypes]
                          ).write.mode("append").parquet(folder)
    return sources.files(spark, folder, rows.schema, files_per_trigger=1_000_000)


@query("d05_stream_interval_labels", with_sql(SIGNALS_SQL, views.ATTACK_LOG_SQL, """
SELECT s.vehicle_id, s.seq, count(a.start_us) > 0 AS in_attack,
       arg_max(a.attack_type, (a.end_us, a.attack_type)) AS attack_type
FROM sig s LEFT JOIN atk a ON s.vehicle_id = a.vehicle_id AND s.us >= a.start_us AND s.us < a.end_us
GROUP BY s.vehicle_id, s.seq"""))
def stream_interval_labels(spark, sf):
    rows = _closed_stream(event_table(spark, sf).select("ts", "vehicle_id", "seq"), "labelled", ["ts"])
    log = _closed_stream(views.attack_log(spark, sf).drop("trigger_type"), "attacks",
                         ["start_time", "end_time"])
    out = joins.label_by_intervals(rows, log, 6 * 3600, "1 day", "1 day")
    return sinks.finish(out, "intervals").where("vehicle_id >= 0").select(
        "vehicle_id", "seq", "in_attack", "attack_type")


@query("d03_stream_location_asof", with_sql(SIGNALS_SQL, LOCATION_SQL, """
SELECT s.vehicle_id, s.seq, l.x, l.y FROM sig s ASOF LEFT JOIN loc l
  ON s.vehicle_id = l.vehicle_id AND s.us >= l.us"""))
def stream_location_asof(spark, sf):
    rows = _closed_stream(event_table(spark, sf).select("ts", "us", "vehicle_id", "seq"), "fast", ["ts"])
    feed = location_feed(spark, sf).withColumn("us", F.unix_micros("ts"))
    slow = _closed_stream(feed.select("ts", "us", "vehicle_id", "seq", "x", "y"), "slow", ["ts"])
    out = joins.asof_merge(rows, slow, ["x", "y"], "1 hour", "1 day")
    return sinks.finish(out, "located").where("vehicle_id >= 0").select("vehicle_id", "seq", "x", "y")


WINDOWS_SQL = with_sql(NUMBERED_SQL, """
raw AS (SELECT n.vehicle_id, n.seq, n.rn, s.value, s.k FROM num n JOIN sig s USING (seq))""", """
SELECT a.vehicle_id, a.seq AS end_seq, round(sum((b.rn - a.rn + 19) * 2 * (b.value + b.k) + b.value + 2 * b.k), 4) AS checksum
FROM raw a JOIN raw b ON a.vehicle_id = b.vehicle_id AND b.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20 GROUP BY 1, 2""")


def _checksums(found):
    weighted = F.transform("flat", lambda x, i: x * (i + 1))
    return found.select(
        "vehicle_id", "end_seq",
        F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query("j06_stream_windows", WINDOWS_SQL)
def stream_windows(spark, sf):
    return _checksums(sinks.finish(_stream_windows(spark, sf), "windows"))


@query("j06_batches_windows", WINDOWS_SQL)
def batches_windows(spark, sf):
    rows = event_table(spark, sf).select(
        "ts", "us", "vehicle_id", "seq", "value", F.col("k").cast("double").alias("k"))
    return _checksums(_by_batches(rows, batches.online_windows(["value", "k"]), "slides",
                                  "vehicle_id long, end_seq long, flat array<double>"))


@query("j06_stream_online_scores")
def stream_online_scores(spark, sf):
    net = nets.GruAutoencoder(features=2)
    scaled = F.array((F.col("value") - 50) / 50, (F.col("k") - 50) / 30)
    rows = event_stream(spark, sf).select("vehicle_id", "us", "seq", scaled.alias("v"))
    scored = stateful.online_scores(rows, net, net.init(42))
    return sinks.finish(scored, "scores").withColumn("score", F.round("score", 6))


@query("j08_stream_round_average", with_sql(WEIGHTS_SQL, """
lat AS (SELECT * FROM upd WHERE update_id % 7 > 2 QUALIFY row_number() OVER (PARTITION BY round, client_id ORDER BY update_id DESC) = 1)""", """
SELECT round, CAST(regexp_extract(key, '[0-9]+') AS INTEGER) * 16 + idx AS idx, round(sum(value * num_samples) / sum(num_samples), 8) AS value
FROM wts JOIN lat USING (client_id, round, update_id) GROUP BY 1, 2"""))
def stream_round_average(spark, sf):
    schema = views.table(spark, sf, "embeddings").schema
    v, v_ = F.col("vec_id"), F.col("update_id")
    updates = sources.table(spark, sf, "embeddings", schema).select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (v % 5).cast("int").alias("round"), v.alias("update_id"), (100 + v % 50).alias("num_samples"),
        (1.0 / (1 + v % 7)).alias("loss"), F.col("embedding").cast("array<double>").alias("weights"))
    # Three of seven updates are damaged: one weight short, a missing weight, no samples.
    w = F.col("weights")
    updates = updates.withColumns({
        "weights": F.when(v_ % 7 == 0, F.slice(w, 1, 63)).when(v_ % 7 == 1, F.transform(
            w, lambda x, i: F.when(i != 5, x))).otherwise(w),
        "num_samples": F.when(v_ % 7 == 2, 0).otherwise(F.col("num_samples"))})
    base = sinks.scratch(spark, "rounds")
    windowed.average_rounds(updates, f"{base}/pending", f"{base}/results", f"{base}/state", n_weights=64).awaitTermination()
    return windowed.latest_rounds(spark, f"{base}/results").withColumn("value", F.round("value", 8))


@query("a05_stream_json_packets", with_sql(PACKETS_SQL, """
SELECT vehicle_id, seq, speed_kmh_value AS speed, brake_attacked, true AS received FROM pk"""))
def stream_json_packets(spark, sf):
    rows = views.packets(spark, sf).drop("ts")
    folder = sinks.scratch(spark, "packets")
    rows.write.json(folder)
    stream = sources.packets(spark, folder, rows.schema)
    return sinks.finish(stream, "ingested").select(
        "vehicle_id", "seq", F.col("speed_kmh.value").alias("speed"),
        F.col("brake.attacked").alias("brake_attacked"), F.col("reception_time").isNotNull().alias("received"))


@query("a06_stream_can_frames", with_sql(FRAMES_SQL, """
SELECT vehicle_id, seq, arbitration_id, hexdata FROM fr WHERE NOT is_error AND NOT is_remote"""))
def stream_can_frames(spark, sf):
    folder = sinks.scratch(spark, "frames")
    frames = views.frames(spark, sf)
    frames.withColumn("vehicle_id", F.col("vehicle_id").cast("int")).write.parquet(folder)
    stream = sources.can_frames(spark, folder).where(~F.col("is_error") & ~F.col("is_remote"))
    return sinks.finish(stream, "landed").select(
        F.col("vehicle_id").cast("long").alias("vehicle_id"), "seq", "arbitration_id",
        F.lower(F.hex("data")).alias("hexdata"))


@query("a11_stream_csv_store", with_sql(SIGNALS_SQL, """
SELECT vehicle_id, seq, value, strftime(ts, '%Y-%m-%d') AS date, us // 600000000 * 600 AS interval_start,
  CASE WHEN k >= 90 THEN 'yes' ELSE 'no' END AS attacked FROM sig"""))
def stream_csv_store(spark, sf):
    flat = event_stream(spark, sf).select(
        "vehicle_id", "seq", "ts", "value", F.when(F.col("k") >= 90, "yes").otherwise("no").alias("attacked"))
    rows = sinks.telemetry_csv(flat).drop("ts")
    return sinks.finish(rows, "csv", "csv", ["date", "interval_start"])


@query("a12_stream_vehicle_log", with_sql(SIGNALS_SQL, "SELECT vehicle_id, seq, us, signal, value FROM sig"))
def stream_vehicle_log(spark, sf):
    rows = event_stream(spark, sf).select("vehicle_id", "seq", "us", "signal", "value")
    # A vehicle's rows go to a few tasks, not to all: few files per folder, and no hot task.
    dealt = rows.withColumn("folder", sinks.folder("vehicle_id")).repartition(
        "folder", F.pmod(F.col("seq"), F.lit(4)))
    return sinks.finish(dealt, "log", partition_by=["folder"]).select(
        "seq", "us", "signal", "value", "vehicle_id")


@query("a13_stream_json_lines", with_sql(SIGNALS_SQL, "SELECT vehicle_id, seq, us, value FROM sig"))
def stream_json_lines(spark, sf):
    return sinks.finish(event_stream(spark, sf).select("vehicle_id", "seq", "us", "value"), "lines", "json")


@query("a14_stream_alerts", with_sql(SIGNALS_SQL, """
SELECT vehicle_id AS client_id, value AS score, 80.0::DOUBLE AS threshold, k AS round, us AS timestamp FROM sig WHERE value > 80"""))
def stream_alerts(spark, sf):
    scored = event_stream(spark, sf).select(
        "vehicle_id", F.col("value").alias("score"), F.col("k").alias("round"), F.col("us").alias("timestamp"))
    body = "client_id long, score double, threshold double, round int, timestamp long"
    return sinks.finish(sinks.alerts(scored, threshold=80.0), "alerts").select(
        F.from_json("value", body).alias("b")).select("b.*")


@query("a15_stream_status_events", with_sql(SIGNALS_SQL, """
SELECT vehicle_id AS client_id, CASE WHEN k % 2 = 0 THEN 'training' ELSE 'idle' END AS status, 'early' AS phase, k AS round, value AS loss, us AS timestamp FROM sig"""))
def stream_status_events(spark, sf):
    rows = event_stream(spark, sf).select(
        F.col("vehicle_id").alias("client_id"), F.when(F.col("k") % 2 == 0, "training").otherwise("idle").alias("status"),
        F.lit("early").alias("phase"), F.col("k").alias("round"), F.col("value").alias("loss"),
        F.col("us").alias("timestamp"))
    return sinks.finish(sinks.status_events(rows), "events")


@query("a04_labelled_csv_scan", with_sql(SIGNALS_SQL, """
SELECT seq, epoch_us(date_trunc('second', ts)) AS us, 'model' AS vehicle_model, value AS speed_kmh, k % 8 - 1 AS gear, k >= 90 AS tampered,
  CASE WHEN k >= 90 THEN 'speed' ELSE 'none' END AS tampering_type FROM sig"""))
def labelled_csv_scan(spark, sf):
    s = views.signals(spark, sf)
    zero = F.lit(0.0)
    rows = s.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("model").alias("vehicle_model"),
        F.col("value").alias("speed_kmh"), F.col("seq").cast("double").alias("location_x"),
        zero.alias("location_y"), zero.alias("location_z"), zero.alias("throttle"), zero.alias("brake"),
        zero.alias("steering"), (F.col("k") % 8 - 1).alias("gear"), (F.col("k") >= 90).alias("tampered"),
        F.when(F.col("k") >= 90, "speed").otherwise("none").alias("tampering_type"))
    folder = sinks.scratch(spark, "labelled")
    rows.write.option("header", "true").csv(folder)
    return readers.labelled_telemetry(spark, folder).select(
        F.col("location_x").cast("long").alias("seq"), F.unix_micros("timestamp").alias("us"), "vehicle_model",
        "speed_kmh", "gear", "tampered", "tampering_type")


@query("a10_attack_log_csv", with_sql(SIGNALS_SQL, views.ATTACK_LOG_SQL, """
SELECT attack_type, start_us, end_us, trigger_type FROM atk"""))
def attack_log_csv(spark, sf):
    folder = sinks.scratch(spark, "attacks")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    views.attack_log(spark, sf).select(
        "attack_type", F.date_format("start_time", stamp).alias("start_time"),
        F.date_format("end_time", stamp).alias("end_time"), "trigger_type",
    ).write.option("header", "true").csv(folder)
    return readers.attack_log(spark, folder).select(
        "attack_type", F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("end_time").alias("end_us"), "trigger_type")


@query("a13_stream_capture_log", with_sql(SIGNALS_SQL, """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp, vehicle_id, seq FROM sig"""))
def stream_capture_log(spark, sf):
    rows = event_stream(spark, sf).select("ts", "vehicle_id", "seq")
    lines = sinks.finish(sinks.capture_lines(rows), "capture", "text")
    cut = F.split("value", " - ", 2)
    body = F.from_json(cut[1], "vehicle_id long, seq long")
    return lines.select(cut[0].alias("stamp"), body.alias("b")).select("stamp", "b.*")


@query("j09_stream_send_decisions", SEND_SQL)
def stream_send_decisions(spark, sf):
    v = F.col("vec_id")
    schema = views.table(spark, sf, "embeddings").schema
    cycles = sources.table(spark, sf, "embeddings", schema).select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (v * 300.0).alias("time_s"), F.floor(v / 20).cast("int").alias("round"),
        F.transform("embedding", lambda x: x.cast("double") * 0.4).alias("weights"),
        (1.0 / (1 + v % 7)).alias("loss"))
    return sinks.finish(stateful.send_decisions(cycles), "sends")


@query("e11_stream_thresholds", """
SELECT l_returnflag, count(l_extendedprice) AS n, true AS within_rank_error FROM lineitem GROUP BY l_returnflag""")
def stream_thresholds(spark, sf):
    table = views.table(spark, sf, "lineitem")
    folder = sinks.scratch(spark, "sketches")
    stream = sources.table(spark, sf, "lineitem", table.schema).select(
        "l_returnflag", F.col("l_extendedprice").cast("double").alias("score"))
    thresholds.follow(stream, folder, ["l_returnflag"], fraction=0.95, factor=1.0).awaitTermination()
    found = thresholds.latest(spark, folder)
    # The threshold's rank among all scores, ties counted on both sides.
    price = F.col("l_extendedprice")
    ranks = table.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "n").agg(
        F.avg((price < F.col("threshold")).cast("double")).alias("below"),
        F.avg((price <= F.col("threshold")).cast("double")).alias("up_to"))
    error = 2 * thresholds.rank_error()
    return ranks.select("l_returnflag", "n", ((F.col("below") <= 0.95 + error) & (
        F.col("up_to") >= 0.95 - error)).alias("within_rank_error"))
