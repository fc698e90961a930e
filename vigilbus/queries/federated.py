"""Federated weight-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilbus.operators import decisions
from vigilbus.operators import federated as fed
from vigilbus.queries.registry import query, with_sql
from vigilbus.session import ensure_checkpoint_dir
from vigilbus.sources import views
from vigilbus.sources.views import UPDATES_SQL, WEIGHTS_SQL

ID = ["client_id", "round", "update_id"]
LATEST_SQL = """lat AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY round, client_id ORDER BY update_id DESC) = 1)"""
AVG_SQL = """av AS (SELECT w.round, w.key, w.idx, sum(w.value * num_samples) / sum(num_samples) AS value
  FROM wts w JOIN lat USING (client_id, round, update_id) GROUP BY w.round, w.key, w.idx)"""


def r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def latest(spark, sf):
    return fed.latest_updates(views.client_updates(spark, sf))


def latest_weights(spark, sf):
    return views.weights(spark, sf).join(latest(spark, sf).select(*ID), ID, "left_semi")


@query("f19_latest_update_per_client", with_sql(UPDATES_SQL, LATEST_SQL,
       "SELECT client_id, round, update_id, num_samples, round(loss, 9) AS loss FROM lat"))
def latest_update(spark, sf):
    return r(latest(spark, sf), 9, "loss")


@query("f19_one_model_per_round", with_sql(UPDATES_SQL, """
SELECT round, max(update_id) AS update_id, arg_max(client_id, update_id) AS client_id FROM upd GROUP BY round"""))
def one_model_per_round(spark, sf):
    rows = views.client_updates(spark, sf).select("round", "update_id", "client_id")
    return fed.latest_updates(rows, ["round"])


@query("e18_federated_average", with_sql(WEIGHTS_SQL, LATEST_SQL, AVG_SQL,
       "SELECT round, key, idx, round(value, 8) AS value FROM av"))
def federated_average(spark, sf):
    return r(fed.average(views.weights(spark, sf), latest(spark, sf)), 8, "value")


@query("e18_round_losses", with_sql(UPDATES_SQL, LATEST_SQL, """
SELECT round, count(DISTINCT client_id) AS clients, CAST(sum(num_samples) AS BIGINT) AS total_samples,
  round(avg(loss), 8) AS avg_loss, round(min(loss), 8) AS min_loss FROM lat GROUP BY round"""))
def round_losses(spark, sf):
    return r(fed.round_losses(latest(spark, sf)), 8, "avg_loss", "min_loss")


@query("e19_layer_norms_average", with_sql(WEIGHTS_SQL, LATEST_SQL, AVG_SQL,
       "SELECT round, key, round(sqrt(sum(value * value)), 8) AS norm FROM av GROUP BY round, key"))
def layer_norms_average(spark, sf):
    averaged = fed.average(views.weights(spark, sf), latest(spark, sf))
    return r(fed.layer_norms(averaged, ["round"]), 8, "norm")


@query("e19_layer_norms_per_client", with_sql(WEIGHTS_SQL, """
SELECT client_id, round, update_id, key, round(sqrt(sum(value * value)), 8) AS norm FROM wts GROUP BY ALL"""))
def layer_norms_client(spark, sf):
    return r(fed.layer_norms(views.weights(spark, sf), ID), 8, "norm")


DRIFT_SQL = """sp AS (SELECT w.round, key, idx, stddev_pop(value) AS s FROM wts w JOIN lat USING (client_id, round, update_id) GROUP BY 1, 2, 3)""", """
dr AS (SELECT round, key, avg(s) AS drift FROM sp GROUP BY 1, 2)"""


@query("e20_layer_drift", with_sql(WEIGHTS_SQL, LATEST_SQL, *DRIFT_SQL,
       "SELECT round, key, round(drift, 8) AS drift FROM dr"))
def layer_drift(spark, sf):
    return r(fed.layer_drift(latest_weights(spark, sf)), 8, "drift")


@query("g02_top_drifting_layers", with_sql(WEIGHTS_SQL, LATEST_SQL, *DRIFT_SQL,
       "SELECT key, round(max(drift), 8) AS drift FROM dr GROUP BY key ORDER BY max(drift) DESC, key LIMIT 3"))
def top_drift(spark, sf):
    return r(fed.top_drift(latest_weights(spark, sf)), 8, "drift")


REF_SQL = """cur AS MATERIALIZED (SELECT client_id, round, key, idx, value FROM wts JOIN lat USING (client_id, round, update_id))""", """
ref AS (SELECT client_id, round + 1 AS round, key, idx, value FROM cur)"""


def _current_reference(spark, sf):
    """Every round's weights of a client, and those of the round before as their reference."""
    w = latest_weights(spark, sf).select("client_id", "round", "key", "idx", "value")
    return w, w.withColumn("round", F.col("round") + 1)


@query("d07_current_vs_reference", with_sql(WEIGHTS_SQL, LATEST_SQL, *REF_SQL, """
SELECT client_id, round, key, idx, round(cur.value - ref.value, 8) AS value FROM cur JOIN ref USING (client_id, round, key, idx)"""))
def current_vs_reference(spark, sf):
    cur, ref = _current_reference(spark, sf)
    return r(fed.difference(cur, ref, ["client_id", "round", "key", "idx"]), 8, "value")


@query("e21_weight_divergence", with_sql(WEIGHTS_SQL, LATEST_SQL, *REF_SQL, """
SELECT client_id, round, round(sqrt(sum((cur.value - ref.value) * (cur.value - ref.value)) / count(ref.value)), 8) AS divergence,
  count(ref.value) > 0 AS has_reference FROM cur LEFT JOIN ref USING (client_id, round, key, idx) GROUP BY client_id, round"""))
def weight_divergence(spark, sf):
    out = fed.divergence(*_current_reference(spark, sf), by=["client_id", "round"])
    known = F.col("divergence") < float("inf")
    return out.select("client_id", "round", F.when(known, F.round("divergence", 8)).alias("divergence"),
                      known.alias("has_reference"))


@query("e22_loss_change", with_sql(UPDATES_SQL, """
SELECT client_id, update_id, round(abs(loss - coalesce(lag(loss) OVER w, 0)) / greatest(coalesce(lag(loss) OVER w, 0), 1e-8::DOUBLE), 6) AS change
FROM upd WINDOW w AS (PARTITION BY client_id ORDER BY update_id)"""))
def loss_change(spark, sf):
    from vigilbus.plans.series import rolling
    rows = rolling(
        views.client_updates(spark, sf), ["client_id"], ["update_id"], 1,
        lambda w, i: {"ref": F.coalesce(F.lag("loss").over(w), F.lit(0.0))})
    return rows.select("client_id", "update_id", F.round(
        fed.loss_change(F.col("loss"), F.col("ref")), 6).alias("change"))


@query("l10_client_update", with_sql(WEIGHTS_SQL, LATEST_SQL, AVG_SQL, """
SELECT w.client_id, w.round, w.key, w.idx, round(w.value - av.value, 8) AS value
FROM wts w JOIN lat USING (client_id, round, update_id) JOIN av ON av.round = w.round AND av.key = w.key AND av.idx = w.idx"""))
def client_update(spark, sf):
    trained = latest_weights(spark, sf)
    start = fed.average(views.weights(spark, sf), latest(spark, sf))
    update = fed.difference(trained, start, ["round", "key", "idx"], ["client_id"])
    return r(update, 8, "value")


@query("c12_update_validation", with_sql(WEIGHTS_SQL, """
SELECT client_id, round, update_id, update_id % 7 > 2 AS accepted,
  CASE update_id % 7 WHEN 0 THEN 'missing key' WHEN 1 THEN 'wrong size' WHEN 2 THEN 'unknown key' END AS reason
FROM upd"""))
def update_validation(spark, sf):
    """Updates damaged in three known ways, by update number."""
    u = F.col("update_id") % 7
    damaged = views.weights(spark, sf).where(
        ~((u == 0) & (F.col("key") == "layer_2")) & ~((u == 1) & (F.col("key") == "layer_1") & (F.col("idx") == 5))
    ).withColumn("key", F.when((u == 2) & (F.col("key") == "layer_3"), "other").otherwise(F.col("key")))
    shapes = {f"layer_{i}": (4, 4) for i in range(4)}
    return fed.validate_updates(damaged, fed.expected_sizes(spark, shapes), len(shapes))


@query("c13_checkpoint_sanity", with_sql(WEIGHTS_SQL, """
nr AS (SELECT update_id, key, sqrt(sum(value * value * CASE WHEN update_id % 5 = 0 THEN 0.000001::DOUBLE ELSE 1.0 END)) AS n
  FROM wts GROUP BY update_id, key)""", """
m AS (SELECT update_id, avg(n) AS mean_norm FROM nr GROUP BY update_id)""", """
SELECT update_id, round(mean_norm, 8) AS mean_norm, mean_norm >= 0.01 AS restored,
  mean_norm >= 0.01 AND update_id % 3 <> 0 AND update_id % 4 <> 0 AS is_calibrated,
  CASE WHEN mean_norm >= 0.01 AND update_id % 3 <> 0 AND update_id % 4 <> 0 THEN 0.5::DOUBLE END AS threshold FROM m"""))
def checkpoint_sanity(spark, sf):
    u = F.col("update_id")
    w = views.weights(spark, sf).withColumn(
        "value", F.col("value") * F.when(u % 5 == 0, 0.001).otherwise(1.0))
    states = views.client_updates(spark, sf).select(
        *ID, (u % 3 != 0).alias("calibrated"), F.when(u % 4 == 0, 1e-6).otherwise(0.5).alias("threshold"))
    return r(fed.checkpoint_state(w, states, ID), 8, "mean_norm").drop("client_id", "round")


CYCLES_SQL = """cy AS (SELECT client_id, update_id AS cycle, 1.0::DOUBLE / (1 + (update_id * 7919) % 13) AS loss FROM upd)"""


def cycles(spark, sf):
    u = F.col("update_id")
    return views.client_updates(spark, sf).select(
        "client_id", u.alias("cycle"), (1.0 / (1 + (u * 7919) % 13)).alias("loss"))


@query("f15_rollback", with_sql(UPDATES_SQL, CYCLES_SQL, """
b AS (SELECT *, row_number() OVER w AS i, min(loss) OVER w AS best_loss FROM cy WINDOW w AS (PARTITION BY client_id ORDER BY cycle ROWS UNBOUNDED PRECEDING))""", """
c AS (SELECT *, coalesce(loss < lag(best_loss) OVER (PARTITION BY client_id ORDER BY cycle), true) AS improved FROM b)""", """
d AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY client_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS worse_streak FROM c)""", """
SELECT client_id, cycle, round(best_loss, 8) AS best_loss, improved, worse_streak, worse_streak > 0 AND worse_streak % 3 = 0 AS rollback FROM d"""))
def rollback(spark, sf):
    return r(fed.rollback(cycles(spark, sf)), 8, "best_loss").drop("loss")


@query("f16_improving", with_sql(UPDATES_SQL, CYCLES_SQL, """
SELECT client_id, cycle, coalesce(loss <= lag(loss, 2) OVER (PARTITION BY client_id ORDER BY cycle), true) AS improving FROM cy"""))
def improving(spark, sf):
    return fed.improving(cycles(spark, sf)).drop("loss")


@query("f17_phase_switch", with_sql(UPDATES_SQL, """
l AS (SELECT client_id, update_id AS cycle, 1.0::DOUBLE / (1 + update_id) + 0.2 + (update_id * 37 % 11) / 1000.0::DOUBLE AS loss FROM upd)""", """
g AS (SELECT *, row_number() OVER w AS i, (lag(loss) OVER w - loss) / lag(loss) OVER w AS gain FROM l WINDOW w AS (PARTITION BY client_id ORDER BY cycle))""", """
m AS (SELECT *, max(CASE WHEN i >= 5 AND gain > 0 AND gain < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS late FROM g)""", """
SELECT client_id, cycle, round(gain, 8) AS improvement, CASE late WHEN 1 THEN 'late' ELSE 'early' END AS phase, CASE late WHEN 1 THEN 3600 ELSE 900 END AS interval_s FROM m"""))
def phase_switch(spark, sf):
    u = F.col("update_id")
    rows = views.client_updates(spark, sf).select(
        "client_id", u.alias("cycle"), (1.0 / (1 + u) + 0.2 + (u * 37 % 11) / 1000.0).alias("loss"))
    return r(fed.phases(rows, "cycle", "loss", ["client_id"]), 8, "improvement").drop("loss")


@query("e32_round_monitor", with_sql(UPDATES_SQL, """
SELECT round, count(DISTINCT client_id) AS clients_seen, count(*) AS updates_received, count(DISTINCT client_id) >= 2 AS ready,
  round(greatest(0.0, (900 - max(update_id % 1000)) / 60.0::DOUBLE), 6) AS minutes_to_next FROM upd GROUP BY round"""))
def round_monitor(spark, sf):
    rows = views.client_updates(spark, sf).withColumns({
        "elapsed_s": F.col("update_id") % 1000, "interval_s": F.lit(900)})
    return r(fed.round_monitor(rows), 6, "minutes_to_next")


@query("a17_weight_checkpoints", with_sql(WEIGHTS_SQL, LATEST_SQL, AVG_SQL, """
SELECT round * 3 AS round, key, idx, round(value, 8) AS value FROM av WHERE round = (SELECT max(round) FROM av)"""))
def weight_checkpoints(spark, sf):
    averaged = fed.average(views.weights(spark, sf), latest(spark, sf))
    path = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
    fed.save_round(averaged.withColumn("round", F.col("round") * 3), path)
    return r(fed.load_latest(spark, path), 8, "value").select("round", "key", "idx", "value")


_DRIFT = ("sqrt(list_sum(list_transform(range(1, len(w) + 1), "
          "lambda j: (w[j] - ref[j]) * (w[j] - ref[j]))) / len(w))")
SEND_SQL = f"""
WITH RECURSIVE cyc AS (
  SELECT 'edge_' || label AS client_id, vec_id * 300.0::DOUBLE AS time_s, (vec_id // 20)::INT AS round,
    list_transform(embedding, lambda x: x::DOUBLE * 0.4) AS w, 1.0::DOUBLE / (1 + vec_id % 7) AS loss,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
st AS (
  SELECT DISTINCT client_id, 0::BIGINT AS n, NULL::DOUBLE AS time_s, NULL::INT AS round, false AS send,
    ''::VARCHAR AS reason, 3600.0::DOUBLE AS wait, NULL::DOUBLE AS since, NULL::DOUBLE[] AS ref,
    NULL::DOUBLE AS ref_loss, NULL::INT AS sent FROM cyc
  UNION ALL
  SELECT client_id, n, time_s, round, send, reason,
    CASE reason WHEN 'concept_drift' THEN 3600.0::DOUBLE
      WHEN 'skipped_stable' THEN least(wait * 1.5, 10800.0)::DOUBLE ELSE wait END,
    CASE WHEN send OR reason = 'skipped_stable' THEN time_s ELSE since END,
    CASE WHEN send THEN w ELSE ref END, CASE WHEN send THEN loss ELSE ref_loss END,
    CASE WHEN send THEN round ELSE sent END
  FROM (SELECT *, reason NOT IN ('already_sent', 'waiting', 'skipped_stable') AS send FROM (
    SELECT *, CASE WHEN round = sent THEN 'already_sent' WHEN ref IS NULL THEN 'initial'
        WHEN time_s - since > 900 AND drift > 0.1 THEN 'weight_divergence'
        WHEN time_s - since > 900 AND abs(loss - ref_loss) / greatest(ref_loss, 1e-8) > 0.3
          THEN 'concept_drift'
        WHEN time_s - since < wait THEN 'waiting' WHEN drift > 0.01 THEN 'scheduled'
        ELSE 'skipped_stable' END AS reason
    FROM (SELECT *, {_DRIFT} AS drift FROM (
      SELECT c.client_id, c.n, c.time_s, c.round, c.w, c.loss, s.wait, s.ref, s.ref_loss, s.sent,
        coalesce(s.since, c.time_s) AS since
      FROM st s JOIN cyc c ON c.client_id = s.client_id AND c.n = s.n + 1)))))
SELECT client_id, time_s, round, send, reason FROM st WHERE n > 0
"""


@query("j09_send_decisions", SEND_SQL)
def send_decisions(spark, sf):
    v = F.col("vec_id")
    rows = views.table(spark, sf, "embeddings").select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (v * 300.0).alias("time_s"), F.floor(v / 20).cast("int").alias("round"),
        F.transform("embedding", lambda x: x.cast("double") * 0.4).alias("weights"),
        (1.0 / (1 + v % 7)).alias("loss"))
    return fed.send_decisions(rows)


CYCLES_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT 'edge_' || label AS client_id, vec_id * 300.0::DOUBLE AS time_s, vec_id AS event,
    CASE WHEN vec_id % 11 = 10 THEN 'global' ELSE 'cycle' END AS kind, (vec_id // 20)::INT AS round,
    list_transform(embedding, lambda x: x::DOUBLE * 0.4) AS w,
    1.0::DOUBLE / (1 + vec_id * 7 // 30 % 7) AS loss, vec_id % 13 = 5 AS requested,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
low AS (
  SELECT *, row_number() OVER o AS i, coalesce(loss < min(loss) OVER (
      PARTITION BY client_id ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best,
    coalesce(loss <= lag(loss, 2) OVER o, true) AS improving
  FROM ev WHERE kind = 'cycle' WINDOW o AS (PARTITION BY client_id ORDER BY event)),
streak AS (
  SELECT *, i - max(CASE WHEN best THEN i END) OVER (PARTITION BY client_id ORDER BY event) AS worse FROM low),
evs AS (
  SELECT ev.*, coalesce(worse > 0 AND worse % 3 = 0, false) AS rolled_back, improving
  FROM ev LEFT JOIN (SELECT event, worse, improving FROM streak) USING (event)),
st AS (
  SELECT DISTINCT client_id, 0::BIGINT AS n, NULL::BIGINT AS event, false AS send, ''::VARCHAR AS reason,
    3600.0::DOUBLE AS wait, NULL::DOUBLE AS since, NULL::DOUBLE[] AS ref, NULL::DOUBLE AS ref_loss,
    NULL::INT AS sent, false AS asked, false AS calibrated, NULL::DOUBLE AS known FROM ev
  UNION ALL
  SELECT client_id, n, event, send, reason,
    CASE rule WHEN 'concept_drift' THEN 3600.0::DOUBLE
      WHEN 'skipped_stable' THEN least(wait * 1.5, 10800.0)::DOUBLE ELSE wait END,
    CASE WHEN send OR kind = 'global' OR rule = 'skipped_stable' THEN time_s ELSE since END,
    CASE WHEN send OR kind = 'global' THEN w ELSE ref END,
    CASE WHEN send OR kind = 'global' THEN now_loss ELSE ref_loss END,
    CASE WHEN send THEN round ELSE sent END,
    asking AND (rolled_back OR kind = 'global'),
    CASE WHEN kind = 'global' THEN false WHEN rolled_back THEN calibrated ELSE true END, now_loss
  FROM (SELECT *, CASE WHEN kind = 'global' THEN 'global_model' WHEN rolled_back THEN 'rolled_back'
        WHEN asking THEN 'server_request' WHEN allowed AND NOT improving THEN 'not_improving'
        ELSE rule END AS reason,
      kind = 'cycle' AND NOT rolled_back AND (asking OR (allowed AND improving)) AS send
    FROM (SELECT *, rule IS NOT NULL AND rule NOT IN ('already_sent', 'waiting', 'skipped_stable') AS allowed
      FROM (SELECT *, CASE WHEN kind = 'global' OR rolled_back OR asking THEN NULL
          WHEN round = sent THEN 'already_sent' WHEN ref IS NULL THEN 'initial'
          WHEN time_s - since > 900 AND drift > 0.1 THEN 'weight_divergence'
          WHEN time_s - since > 900 AND (ref_loss IS NULL
            OR abs(loss - ref_loss) / greatest(ref_loss, 1e-8) > 0.3) THEN 'concept_drift'
          WHEN time_s - since < wait THEN 'waiting' WHEN drift > 0.01 THEN 'scheduled'
          ELSE 'skipped_stable' END AS rule
        FROM (SELECT *, {_DRIFT} AS drift FROM (
          SELECT c.client_id, c.n, c.event, c.time_s, c.kind, c.round, c.w, c.loss, c.rolled_back,
            c.improving, s.wait, s.ref, s.ref_loss, s.sent, s.calibrated,
            s.asked OR (c.kind = 'cycle' AND c.requested) AS asking,
            coalesce(s.since, c.time_s) AS since,
            CASE WHEN c.kind = 'cycle' THEN c.loss ELSE s.known END AS now_loss
          FROM st s JOIN evs c ON c.client_id = s.client_id AND c.n = s.n + 1))))))
SELECT evs.client_id, evs.time_s, evs.event, evs.kind, evs.round, evs.rolled_back, evs.improving,
  st.send, st.reason, st.calibrated
FROM st JOIN evs ON st.event = evs.event
"""


@query("l03_cycle_decisions", CYCLES_SQL)
def cycle_decisions(spark, sf):
    v = F.col("vec_id")
    cycle = v % 11 != 10
    return decisions.cycle_decisions(views.table(spark, sf, "embeddings").select(
        F.concat(F.lit("edge_"), F.col("label").cast("string")).alias("client_id"),
        (v * 300.0).alias("time_s"), v.alias("event"),
        F.when(cycle, "cycle").otherwise("global").alias("kind"),
        F.floor(v / 20).cast("int").alias("round"),
        F.transform("embedding", lambda x: x.cast("double") * 0.4).alias("weights"),
        F.when(cycle, 1.0 / (1 + F.floor(v * 7 / 30) % 7)).alias("loss"),
        F.when(cycle, v % 13 == 5).alias("requested")))
