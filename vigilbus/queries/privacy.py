"""Privacy queries on vectors, weights and noise events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilbus.operators import privacy as P
from vigilbus.queries.federated import ID, r
from vigilbus.queries.injection import u
from vigilbus.queries.registry import query, with_sql
from vigilbus.sources import views
from vigilbus.sources.views import WEIGHTS_SQL


def gauss(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0 - {u(seed + 'a', *keys)})) * cos(2.0 * pi() * {u(seed + 'b', *keys)}))"


def lap(seed: str, *keys: str) -> str:
    x = f"({u(seed, *keys)} - 0.5)"
    return f"(-sign({x}) * ln(greatest(1.0 - 2.0 * abs({x}), pow(2.0::DOUBLE, -52))))"


UPDATE = ("client_id", "round", "update_id")
CELL = (*UPDATE, "key", "idx")
BIG = "big AS (SELECT client_id, round, update_id, key, idx, value * (1 + update_id % 3) AS value FROM wts)"
CLIP = "value * least(1.0, 1.0::DOUBLE / (sqrt(sum(value * value) OVER (PARTITION BY {})) + 1e-8))"


def enlarged(spark, sf):
    return views.weights(spark, sf).withColumn(
        "value", F.col("value") * (1 + F.col("update_id") % 3))


@query("e26_clip_global", with_sql(WEIGHTS_SQL, BIG, f"""
SELECT update_id, key, idx, round({CLIP.format('update_id')}, 8) AS value FROM big"""))
def clip_global(spark, sf):
    return r(P.clip(enlarged(spark, sf), ID), 8, "value").select("update_id", "key", "idx", "value")


@query("e26_clip_per_tensor", with_sql(WEIGHTS_SQL, BIG, f"""
SELECT update_id, key, idx, round({CLIP.format('update_id, key')}, 8) AS value FROM big"""))
def clip_per_tensor(spark, sf):
    return r(P.clip(enlarged(spark, sf), [*ID, "key"]), 8, "value").select(
        "update_id", "key", "idx", "value")


@query("e26_clip_per_vector", with_sql(WEIGHTS_SQL, """
SELECT update_id, round(least(1.0, 0.5::DOUBLE / (sqrt(sum(value * value)) + 1e-8)) * sqrt(sum(value * value)), 6) AS norm,
  round(sum(value) * least(1.0, 0.5::DOUBLE / (sqrt(sum(value * value)) + 1e-8)), 6) AS total FROM wts GROUP BY update_id"""))
def clip_per_vector(spark, sf):
    v = P.clip_vector(F.col("embedding").cast("array<double>"), 0.5)
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("update_id"), v.alias("v")).select(
        "update_id", F.round(P.vector_norm(F.col("v")), 6).alias("norm"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


LEAK_SQL = """pr AS (SELECT update_id, key, value AS o, value * 0.9::DOUBLE + CASE WHEN idx % 2 = 0 THEN 0.05 ELSE -0.02 END AS p FROM wts)""", """
tn AS (SELECT update_id, key, sum(o * p) / (sqrt(sum(o * o)) * sqrt(sum(p * p))) AS c, sqrt(sum((o - p) * (o - p))) / (sqrt(sum(o * o)) + 1e-8) AS e FROM pr GROUP BY 1, 2)"""


@query("e25_leakage_resistance", with_sql(WEIGHTS_SQL, *LEAK_SQL, """
SELECT update_id, round(avg(c), 6) AS cosine_similarity, round(avg(e), 6) AS relative_error,
  round(0.5 * (1 - avg(c)) + 0.5 * least(1.0, avg(e)), 6) AS resistance FROM tn GROUP BY update_id"""))
def leakage_resistance(spark, sf):
    shift = F.when(F.col("idx") % 2 == 0, 0.05).otherwise(-0.02)
    pairs = views.weights(spark, sf).select(
        "update_id", "key", "idx", F.col("value").alias("original"),
        (F.col("value") * 0.9 + shift).alias("protected"))
    return r(P.leakage(pairs, ["update_id"]), 6, "cosine_similarity", "relative_error", "resistance")


EVENTS_SQL = """ev AS (SELECT o_custkey AS client_id, o_orderkey AS step, (1 + o_orderkey % 5) * 0.5::DOUBLE AS noise_multiplier,
  (1 + o_orderkey % 10) / 100.0::DOUBLE AS sample_rate, 1 + o_orderkey % 20 AS steps FROM orders)"""
EPS = "(sample_rate * sample_rate * 2.0 / (2 * noise_multiplier * noise_multiplier) * steps + ln(100000.0::DOUBLE))"


def noise_events(spark, sf):
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("client_id"), k.alias("step"),
        ((1 + k % 5) * 0.5).alias("noise_multiplier"), ((1 + k % 10) / 100.0).alias("sample_rate"),
        (1 + k % 20).alias("steps"))


@query("e27_privacy_ledger", with_sql(EVENTS_SQL, f"""
a AS (SELECT client_id, step, {EPS} AS epsilon, sum({EPS}) OVER (PARTITION BY client_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS spent FROM ev)""", """
SELECT client_id, step, round(epsilon, 6) AS epsilon, round(spent, 6) AS epsilon_spent,
  round(greatest(0.0, 50.0 - spent), 6) AS remaining, spent >= 50.0 AS exhausted FROM a"""))
def privacy_ledger(spark, sf):
    return r(P.ledger(noise_events(spark, sf), 50.0), 6, "epsilon", "epsilon_spent", "remaining").drop(
        "noise_multiplier", "sample_rate", "steps")


@query("e27_privacy_ledger_composed", with_sql(EVENTS_SQL, f"""
a AS (SELECT client_id, step, sum({EPS} - ln(100000.0::DOUBLE)) OVER (PARTITION BY client_id ORDER BY step ROWS UNBOUNDED PRECEDING) + ln(100000.0::DOUBLE) AS spent FROM ev)""", """
SELECT client_id, step, round(spent, 6) AS epsilon_spent, spent >= 12.0 AS exhausted FROM a"""))
def privacy_ledger_composed(spark, sf):
    out = P.ledger(noise_events(spark, sf), 12.0, composed=True)
    return r(out, 6, "epsilon_spent").select("client_id", "step", "epsilon_spent", "exhausted")


@query("e28_query_epsilon", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(2 * ln(1.25::DOUBLE / 0.00001::DOUBLE)) / l_quantity, 8) AS gaussian_epsilon,
  round(1.0::DOUBLE / l_quantity, 8) AS laplace_epsilon FROM lineitem""")
def query_epsilon(spark, sf):
    q = F.col("l_quantity")
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(P.gaussian_epsilon(q), 8).alias("gaussian_epsilon"),
        F.round(P.laplace_epsilon(q), 8).alias("laplace_epsilon"))


def _perturbed_vectors_sql(draw) -> str:
    return with_sql(WEIGHTS_SQL, """
nm AS (SELECT update_id, CAST(regexp_extract(key, '[0-9]+') AS INTEGER) * 16 + idx AS pos, value,
  value * least(1.0, 1.0::DOUBLE / (sqrt(sum(value * value) OVER (PARTITION BY update_id)) + 1e-8)) AS c FROM wts)""", f"""
SELECT update_id, round(sum((pos + 1) * (c + {draw} * 0.1::DOUBLE)), 6) AS checksum FROM nm GROUP BY update_id""")


def _perturbed_vectors(spark, sf, mechanism):
    rows = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("update_id"), "embedding")
    out = P.perturb_vectors(rows, "embedding", ["update_id"], mechanism=mechanism)
    weighted = F.transform("embedding", lambda x, i: x * (i + 1))
    return out.select("update_id", F.round(
        F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 6).alias("checksum"))


@query("l07_input_perturbation_gaussian", _perturbed_vectors_sql(gauss("11", "update_id", "pos")))
def input_perturbation_gaussian(spark, sf):
    return _perturbed_vectors(spark, sf, "gaussian")


@query("l07_input_perturbation_laplace", _perturbed_vectors_sql(lap("11", "update_id", "pos")))
def input_perturbation_laplace(spark, sf):
    return _perturbed_vectors(spark, sf, "laplace")


@query("l08_output_perturbation_update", with_sql(WEIGHTS_SQL, BIG, f"""
SELECT update_id, key, idx, round({CLIP.format('update_id, key')} + {gauss('12', *CELL)} * 0.01::DOUBLE, 8) AS value FROM big"""))
def output_perturbation_update(spark, sf):
    return r(P.perturb_update(enlarged(spark, sf), ID), 8, "value").select(
        "update_id", "key", "idx", "value")


@query("l08_output_perturbation_gradients", with_sql(WEIGHTS_SQL, BIG, f"""
SELECT update_id, key, idx, round({CLIP.format('update_id')} + {lap('13', *CELL)} * 0.01::DOUBLE, 8) AS value FROM big"""))
def output_perturbation_gradients(spark, sf):
    return r(P.perturb_gradients(enlarged(spark, sf), ID, mechanism="laplace"), 8, "value").select(
        "update_id", "key", "idx", "value")


@query("l09_dp_sgd_gradient", with_sql(WEIGHTS_SQL, BIG, f"""
cl AS (SELECT round, key, idx, {CLIP.format('update_id')} AS c FROM big)""", f"""
mn AS (SELECT round, key, idx, avg(c) AS m, count(*) AS n FROM cl GROUP BY 1, 2, 3)""", f"""
SELECT round, key, idx, round(m + {gauss('14', 'round', 'key', 'idx')} * 1.1::DOUBLE / n, 8) AS value FROM mn"""))
def dp_sgd_gradient(spark, sf):
    return r(P.dp_sgd_gradient(enlarged(spark, sf), ID, ["round"]), 8, "value")
