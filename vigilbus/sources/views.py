"""Telemetry-shaped views of the test tables, one DataFrame function and one SQL text each.

The SQL texts are common table expressions for the checking engine; both sides derive the same
rows from ``events``, ``embeddings``, ``orders`` and ``documents``/``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilbus.operators.state import assemble_state
from vigilbus.schema import SIGNAL_CODES

_EVENT_SIGNALS = [
    ("click", "speed_kmh", 0x23), ("purchase", "battery_level", 0x24), ("view", "throttle", 0x25),
    ("error", "brake", 0x26), ("signup", "steering", 0x27),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload() -> Column:
    """The number in props, which is always {"k": number}."""
    return F.trim(F.substring_index(F.substring_index("props", ":", -1), "}", 1)).cast("int")


def _event_case(position: int) -> Column:
    out = F.lit(None)
    for row in _EVENT_SIGNALS:
        out = F.when(F.col("event_type") == row[0], F.lit(row[position])).otherwise(out)
    return out


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, vehicle_id, seq, signal, value, k) rows from ``events``."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("vehicle_id"),
        F.col("event_id").alias("seq"),
        _event_case(1).alias("signal"),
        "value",
        payload().alias("k"),
    )


SIGNALS_SQL = """sig AS (
  SELECT ts, epoch_us(ts) AS us, user_id AS vehicle_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'speed_kmh' WHEN 'purchase' THEN 'battery_level'
              WHEN 'view' THEN 'throttle' WHEN 'error' THEN 'brake'
              WHEN 'signup' THEN 'steering' END AS signal,
         value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-known state per event, with gear, location and an attacked mark from the payload."""
    state = assemble_state(signals(spark, sf_dir), keep=["k", "value", "signal"])
    return state.select(
        "ts", "vehicle_id", "seq", "speed_kmh", "battery_level", "throttle", "brake", "steering",
        (F.col("k") % 8 - 1).cast("double").alias("gear"),
        (F.col("value") * 10).alias("location_x"),
        F.col("k").cast("double").alias("location_y"),
        (F.col("k") >= 90).alias("attacked"),
    )


TELEMETRY_SQL = SIGNALS_SQL + """, tel AS (
  SELECT ts, us, vehicle_id, seq,
    coalesce(last_value(CASE WHEN signal='speed_kmh' THEN value END IGNORE NULLS) OVER w, 0.0) AS speed_kmh,
    coalesce(last_value(CASE WHEN signal='battery_level' THEN value END IGNORE NULLS) OVER w, 85.0) AS battery_level,
    coalesce(last_value(CASE WHEN signal='throttle' THEN value END IGNORE NULLS) OVER w, 0.0) AS throttle,
    coalesce(last_value(CASE WHEN signal='brake' THEN value END IGNORE NULLS) OVER w, 0.0) AS brake,
    coalesce(last_value(CASE WHEN signal='steering' THEN value END IGNORE NULLS) OVER w, 0.0) AS steering,
    CAST(k % 8 - 1 AS DOUBLE) AS gear, value * 10 AS location_x, CAST(k AS DOUBLE) AS location_y,
    (k >= 90) AS attacked
  FROM sig
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus frames: payload bytes from a digest of the event, with short, empty, error, remote
    and unmapped frames among them."""
    k = F.col("k")
    length = F.when(k % 50 == 1, 0).when(k % 25 == 0, 3).otherwise(8)
    code = F.when(k >= 95, 0x60 + k % 8).when(k % 20 == 7, 0x28).otherwise(_event_case(2))
    events = table(spark, sf_dir, "events").withColumn(
        "k", payload()
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("vehicle_id"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 256 + code).cast("int").alias("arbitration_id"),
        F.unhex(F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), length * 2))
        .alias("data"),
        (k == 13).alias("is_error"),
        (k == 17).alias("is_remote"),
    )


FRAMES_SQL = SIGNALS_SQL + """, fr AS (
  SELECT ts, us, vehicle_id, seq,
    CAST(vehicle_id * 256 + CASE WHEN k >= 95 THEN 96 + k % 8 WHEN k % 20 = 7 THEN 40
      ELSE CASE signal WHEN 'speed_kmh' THEN 35 WHEN 'battery_level' THEN 36 WHEN 'throttle' THEN 37
                       WHEN 'brake' THEN 38 ELSE 39 END END AS INTEGER) AS arbitration_id,
    substr(md5(CAST(seq AS VARCHAR)), 1,
           2 * CASE WHEN k % 50 = 1 THEN 0 WHEN k % 25 = 0 THEN 3 ELSE 8 END) AS hexdata,
    k = 13 AS is_error, k = 17 AS is_remote
  FROM sig), dim(code, signal, kind) AS (VALUES (35,'speed_kmh','f32'), (36,'battery_level','f32'),
    (37,'throttle','f32'), (38,'brake','f32'), (39,'steering','f32'), (40,'gear','i32'))"""


def signal_dim(spark: SparkSession) -> DataFrame:
    """Signal per low ID byte (six fixed rows)."""
    rows = [F.struct(F.lit(c).alias("code"), F.lit(s).alias("signal"), F.lit(k).alias("kind"))
            for c, s, k in SIGNAL_CODES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested packets: one struct per signal, some missing, legacy scalars for one source."""
    k = F.col("k")
    us = F.unix_micros("ts")

    def signal(name: str, offset: int) -> Column:
        carries = (k + offset) % 5 != 0
        legacy = (k + offset) % 11 == 0
        body = F.struct(
            F.when(~legacy, F.col("value") + offset).alias("value"),
            F.when((k + offset) % 3 != 0, (us - offset * 1000) / 1e6).alias("raw_timestamp"),
            F.when(k + offset >= 97, "yes").otherwise("no").alias("attacked"),
        )
        return F.when(carries, body).alias(name)

    return signals(spark, sf_dir).select(
        "vehicle_id", "seq", "ts",
        (us + k * 20_000).alias("reception_us"),
        *[signal(n, i) for i, n in enumerate(_PACKET_COLUMNS)],
        *[F.when((k + i) % 11 == 0, F.col("value") - i).alias(f"{n}_scalar")
          for i, n in enumerate(_PACKET_COLUMNS)],
        F.struct((F.col("value") * 3.14159).alias("x"), F.when(k % 4 != 0, F.col("value") / 7)
                 .alias("y"), F.lit(0.0).alias("z")).alias("location"),
    )


_PACKET_COLUMNS = ["speed_kmh", "battery_level", "throttle", "brake", "steering", "gear"]

PACKETS_SQL = SIGNALS_SQL + ", pk AS (SELECT vehicle_id, seq, ts, us, us + k * 20000 AS reception_us, " + ", ".join(
    f"(k + {i}) % 5 <> 0 AS {n}_has, "
    f"CASE WHEN (k + {i}) % 5 <> 0 AND (k + {i}) % 11 <> 0 THEN value + {i} END AS {n}_value, "
    f"CASE WHEN (k + {i}) % 5 <> 0 AND (k + {i}) % 3 <> 0 THEN (us - {i * 1000}) / 1000000.0::DOUBLE END AS {n}_raw, "
    f"CASE WHEN (k + {i}) % 5 <> 0 THEN CASE WHEN k + {i} >= 97 THEN 'yes' ELSE 'no' END END AS {n}_attacked, "
    f"CASE WHEN (k + {i}) % 11 = 0 THEN value - {i} END AS {n}_scalar"
    for i, n in enumerate(_PACKET_COLUMNS)
) + ", value * 3.14159::DOUBLE AS x, CASE WHEN k % 4 <> 0 THEN value / 7 END AS y FROM sig)"


def attack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-hour interval per event with payload 99."""
    start = F.col("ts")
    return signals(spark, sf_dir).where("k = 99").select(
        "vehicle_id",
        F.concat(F.lit("replay_"), "signal").alias("attack_type"),
        start.alias("start_time"),
        (start + F.expr("INTERVAL 2 HOURS")).alias("end_time"),
        F.when(F.col("seq") % 2 == 0, "manual").otherwise("scheduled").alias("trigger_type"),
    )


ATTACK_LOG_SQL = """atk AS (
  SELECT vehicle_id, 'replay_' || signal AS attack_type, us AS start_us,
         us + 7200000000 AS end_us,
         CASE WHEN seq % 2 = 0 THEN 'manual' ELSE 'scheduled' END AS trigger_type
  FROM sig WHERE k = 99)"""


def client_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, round, num_samples, loss, update_id) from ``embeddings``."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (v % 5).cast("int").alias("round"),
        v.alias("update_id"),
        (100 + v % 50).alias("num_samples"),
        (1.0 / (1 + v % 7)).alias("loss"),
    )


UPDATES_SQL = """upd AS (
  SELECT 'edge_' || label AS client_id, CAST(vec_id % 5 AS INTEGER) AS round, vec_id AS update_id,
         100 + vec_id % 50 AS num_samples, 1.0::DOUBLE / (1 + vec_id % 7) AS loss FROM embeddings)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long weight table: 64 elements per update in four keys of sixteen."""
    place = F.col("pos")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (F.col("vec_id") % 5).cast("int").alias("round"),
        F.col("vec_id").alias("update_id"),
        F.posexplode("embedding").alias("pos", "w"),
    ).select(
        "client_id", "round", "update_id",
        F.concat(F.lit("layer_"), F.floor(place / 16).cast("string")).alias("key"),
        (place % 16).alias("idx"),
        F.col("w").cast("double").alias("value"),
    )


WEIGHTS_SQL = UPDATES_SQL + """, wts AS MATERIALIZED (
  SELECT 'edge_' || label AS client_id, CAST(vec_id % 5 AS INTEGER) AS round, vec_id AS update_id,
         'layer_' || CAST(p // 16 AS VARCHAR) AS key, CAST(p % 16 AS INTEGER) AS idx,
         CAST(embedding[p + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS p))"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, label, kind, threshold-ready) from documents and their labels."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("kind")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


SCORES_SQL = """sc AS (
  SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS score, source AS kind, quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
