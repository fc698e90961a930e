"""Clipping, noise and privacy accounting on weight tables and vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilbus.functions import noise
from vigilbus.plans.series import running

TINY = 1e-8


def clip_factor(norm: Column, limit: float) -> Column:
    return F.least(F.lit(1.0), F.lit(limit) / (norm + TINY))


def _norm_over(by: Sequence[str]) -> Column:
    # A group is one update or one tensor, so its size is bounded by the model.
    squares = F.sum(F.col("value") * F.col("value"))
    return F.sqrt(squares.over(Window.partitionBy(*by)))


def clip(weights: DataFrame, by: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Scale each group down to an L2 norm of at most ``limit``.

    Group by update for the global form, by update and key for the per-tensor form.
    """
    return weights.withColumn("_norm", _norm_over(by)).withColumn(
        "value", F.col("value") * clip_factor(F.col("_norm"), limit)).drop("_norm")


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def clip_vector(v: Column, limit: float = 1.0) -> Column:
    factor = clip_factor(vector_norm(v), limit)
    return F.transform(v, lambda x: x * factor)


def draw(mechanism: str, seed: int | str, *keys: Column | str) -> Column:
    return (noise.gaussian if mechanism == "gaussian" else noise.laplace)(seed, *keys)


def perturb_vectors(df: DataFrame, vector: str, keys: Sequence[str], scale: float = 0.1,
                    limit: float = 1.0, mechanism: str = "gaussian", seed: int = 11) -> DataFrame:
    """Input perturbation: clip each vector, then add noise per element."""
    clipped = df.withColumn("_v", clip_vector(F.col(vector).cast("array<double>"), limit))
    noisy = F.transform("_v", lambda x, i: x + draw(mechanism, seed, *keys, i) * scale)
    return clipped.withColumn(vector, noisy).drop("_v")


def perturb_update(weights: DataFrame, update: Sequence[str], scale: float = 0.01,
                   limit: float = 1.0, mechanism: str = "gaussian", seed: int = 12) -> DataFrame:
    """Output perturbation of a model update: per-tensor clip, noise scaled by the limit."""
    rows = clip(weights, [*update, "key"], limit)
    return rows.withColumn(
        "value", F.col("value") + draw(mechanism, seed, *update, "key", "idx") * (scale * limit))


def perturb_gradients(weights: DataFrame, update: Sequence[str], scale: float = 0.01,
                      limit: float = 1.0, mechanism: str = "gaussian", seed: int = 13) -> DataFrame:
    """Output perturbation of gradients: clip over all tensors, noise not scaled."""
    rows = clip(weights, update, limit)
    return rows.withColumn(
        "value", F.col("value") + draw(mechanism, seed, *update, "key", "idx") * scale)


def dp_sgd_gradient(samples: DataFrame, sample: Sequence[str], batch: Sequence[str],
                    multiplier: float = 1.1, limit: float = 1.0, seed: int = 14) -> DataFrame:
    """Per-sample clip over all tensors, mean per element, noise of multiplier * limit / n."""
    clipped = clip(samples, sample, limit)
    means = clipped.groupBy(*batch, "key", "idx").agg(
        F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    shake = noise.gaussian(seed, *batch, "key", "idx") * (multiplier * limit) / F.col("_n")
    return means.select(*batch, "key", "idx", (F.col("_mean") + shake).alias("value"))


def leakage(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cosine similarity and relative error averaged over tensors, and the resistance score.

    Input: (by, key, idx, original, protected).
    """
    o, p = F.col("original"), F.col("protected")
    tensors = pairs.groupBy(*by, "key").agg(
        F.sum(o * p).alias("_op"), F.sqrt(F.sum(o * o)).alias("_o"),
        F.sqrt(F.sum(p * p)).alias("_p"), F.sqrt(F.sum((o - p) * (o - p))).alias("_d"))
    cosine = F.col("_op") / (F.greatest("_o", F.lit(TINY)) * F.greatest("_p", F.lit(TINY)))
    means = tensors.groupBy(*by).agg(
        F.avg(cosine).alias("cosine_similarity"),
        F.avg(F.col("_d") / (F.col("_o") + TINY)).alias("relative_error"))
    return means.withColumn(
        "resistance", 0.5 * (1 - F.col("cosine_similarity"))
        + 0.5 * F.least(F.lit(1.0), F.col("relative_error")))


def event_epsilon(multiplier: Column, rate: Column, steps: Column, delta: float = 1e-5,
                  order: float = 2.0) -> Column:
    """Privacy cost of one event; infinite without noise."""
    spent = rate * rate * order / (2 * multiplier * multiplier) * steps
    cost = spent + math.log(1 / delta) / (order - 1)
    return F.when(multiplier == 0, float("inf")).otherwise(cost)


def ledger(events: DataFrame, budget: float, client: str = "client_id",
           order: Sequence[str] = ("step",), delta: float = 1e-5, composed: bool = False,
           target_rows: float | None = None) -> DataFrame:
    """Cost per event, running total, budget left and whether it is used up, per client.

    By default every event adds the log(1/delta) term; ``composed`` adds it once per client.
    """
    full = event_epsilon(F.col("noise_multiplier"), F.col("sample_rate"), F.col("steps"), delta)
    fixed = math.log(1 / delta)
    rows = events.withColumn("epsilon", full - fixed if composed else full)
    rows = running(rows, [client], list(order), {"_sum": ("sum", F.col("epsilon"))}, target_rows)
    spent = F.col("_sum") + fixed if composed else F.col("_sum")
    return rows.withColumn("epsilon_spent", spent).withColumns({
        "remaining": F.greatest(F.lit(0.0), F.lit(budget) - F.col("epsilon_spent")),
        "exhausted": F.col("epsilon_spent") >= budget,
    }).drop("_sum")


def gaussian_epsilon(scale: Column, sensitivity: float = 1.0, delta: float = 1e-5) -> Column:
    return F.lit(sensitivity * math.sqrt(2 * math.log(1.25 / delta))) / scale


def laplace_epsilon(scale: Column, sensitivity: float = 1.0) -> Column:
    return F.lit(sensitivity) / scale
