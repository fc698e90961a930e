"""Weight tables: validation, averaging, drift, rounds and send decisions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilbus.plans.series import positions, rolling, running, settle, small_side
from vigilbus.schema import weight_shapes

# Limits of the send rule, of rollback and of the round schedule.
DIVERGENCE_LIMIT = 0.10
LOSS_LIMIT = 0.30
STABLE_DIVERGENCE = 0.01
BACKOFF = 1.5
BACKOFF_CEILING = 3.0
PATIENCE = 3
EARLY_ROUNDS = 5
IMPROVEMENT = 0.05
EARLY_S = 900
LATE_S = 3600


def expected_sizes(spark: SparkSession, shapes: Mapping[str, tuple] | None = None) -> DataFrame:
    """Element count per weight key (one row per tensor of the model)."""
    rows = [(k, prod(s)) for k, s in (shapes or weight_shapes()).items()]
    return spark.createDataFrame(rows, "key string, expected long")


def validate_updates(weights: DataFrame, sizes: DataFrame, n_keys: int,
                     by: Sequence[str] = ("client_id", "round", "update_id")) -> DataFrame:
    """``accepted`` and ``reason`` per update: every key present, none unknown, exact sizes."""
    tensors = weights.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    checked = tensors.join(F.broadcast(sizes), "key", "left").groupBy(*by).agg(
        F.count_if(F.col("expected").isNull()).alias("_unknown"),
        F.count_if(F.col("expected").isNotNull()).alias("_known"),
        F.count_if((F.col("_n") != F.col("expected")) | (F.col("_lo") != 0)
                   | (F.col("_hi") != F.col("expected") - 1)).alias("_wrong"))
    reason = (
        F.when(F.col("_unknown") > 0, "unknown key")
        .when(F.col("_known") < n_keys, "missing key")
        .when(F.col("_wrong") > 0, "wrong size")
    )
    return checked.select(*by, reason.isNull().alias("accepted"), reason.alias("reason"))


def latest_updates(updates: DataFrame, by: Sequence[str] = ("round", "client_id"),
                   order: str = "update_id") -> DataFrame:
    """The last update of each client and round (combined before the shuffle)."""
    rest = [c for c in updates.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.col(order))
    return updates.groupBy(*by).agg(newest.alias("_u")).select(*by, "_u.*")


def average(weights: DataFrame, updates: DataFrame,
            on: Sequence[str] = ("client_id", "round", "update_id")) -> DataFrame:
    """Sample-weighted mean per (round, key, idx); null if the round has no samples."""
    rows = weights.join(small_side(updates.select(*on, "num_samples")), list(on))
    weighted = F.sum(F.col("value") * F.col("num_samples"))
    return rows.groupBy("round", "key", "idx").agg(
        F.try_divide(weighted, F.sum("num_samples").cast("double")).alias("value"))


def round_losses(updates: DataFrame) -> DataFrame:
    """Clients, samples and the unweighted mean loss per round."""
    return updates.groupBy("round").agg(
        F.count_distinct("client_id").alias("clients"),
        F.sum("num_samples").alias("total_samples"),
        F.avg("loss").alias("avg_loss"), F.min("loss").alias("min_loss"))


def layer_norms(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    return weights.groupBy(*by, "key").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def layer_drift(weights: DataFrame) -> DataFrame:
    """Mean over a layer's elements of the population deviation across clients."""
    spread = weights.groupBy("round", "key", "idx").agg(F.stddev_pop("value").alias("_s"))
    return spread.groupBy("round", "key").agg(F.avg("_s").alias("drift"))


def top_drift(weights: DataFrame, k: int = 3) -> DataFrame:
    """The k layers that drift most, over all rounds given."""
    drift = layer_drift(weights).groupBy("key").agg(F.max("drift").alias("drift"))
    return drift.orderBy(F.col("drift").desc(), "key").limit(k)


def divergence(current: DataFrame, reference: DataFrame,
               by: Sequence[str] = ("client_id",)) -> DataFrame:
    """RMS difference of each client's weights from its reference; infinite without one."""
    ref = reference.select(*by, "key", "idx", F.col("value").alias("_ref"))
    joined = current.join(ref, [*by, "key", "idx"], "left")
    d = F.col("value") - F.col("_ref")
    return joined.groupBy(*by).agg(
        F.sum(d * d).alias("_sq"), F.count("_ref").alias("_n")
    ).select(*by, F.when(F.col("_n") > 0, F.sqrt(F.col("_sq") / F.col("_n")))
             .otherwise(float("inf")).alias("divergence"))


def loss_change(loss, reference):
    return F.abs(loss - reference) / F.greatest(reference, F.lit(1e-8))


def difference(trained: DataFrame, initial: DataFrame, keys: Sequence[str],
               keep: Sequence[str] = ()) -> DataFrame:
    """Client update: trained minus initial weights, matched by ``keys``."""
    start = initial.select(*keys, F.col("value").alias("_start"))
    return trained.join(start, list(keys)).select(
        *keep, *keys, (F.col("value") - F.col("_start")).alias("value"))


def rollback(cycles: DataFrame, client: str = "client_id", order: Sequence[str] = ("cycle",),
             patience: int = PATIENCE, target_rows: float | None = None) -> DataFrame:
    """Best loss so far, length of the current worse streak and rollbacks.

    A rollback resets the counter but not the best loss, so it recurs every ``patience`` rows.
    """
    order = list(order)
    target_rows = settle(cycles, [client], target_rows)
    rows = positions(cycles, [client], order, "_i", target_rows)
    rows = running(rows, [client], order, {"best_loss": ("min", F.col("loss"))}, target_rows)
    rows = rolling(rows, [client], order, 1, lambda w, i: {
        "improved": F.coalesce(F.col("loss") < F.lag("best_loss").over(w), F.lit(True))},
        target_rows)
    rows = running(rows, [client], order,
                   {"_best_at": ("last", F.when(F.col("improved"), F.col("_i")))}, target_rows)
    streak = F.col("_i") - F.col("_best_at")
    return rows.withColumns({
        "worse_streak": streak, "rollback": (streak > 0) & (streak % patience == 0),
    }).drop("_i", "_best_at")


def improving(cycles: DataFrame, client: str = "client_id", order: Sequence[str] = ("cycle",),
              target_rows: float | None = None) -> DataFrame:
    """Loss no higher than two cycles earlier; true for the first two."""
    return rolling(cycles, [client], list(order), 2, lambda w, i: {
        "improving": F.coalesce(F.col("loss") <= F.lag("loss", 2).over(w), F.lit(True))},
        target_rows)


def phases(rounds: DataFrame, order: str = "round", loss: str = "avg_loss",
           keys: Sequence[str] = (), early_rounds: int = EARLY_ROUNDS,
           improvement: float = IMPROVEMENT, target_rows: float | None = None) -> DataFrame:
    """Early until the first small positive improvement from round ``early_rounds`` on, then late."""
    def build(w, index):
        before = F.lag(loss).over(w)
        gain = F.try_divide(before - F.col(loss), F.when(before > 0, before))
        small = (index >= early_rounds) & (gain > 0) & (gain < improvement)
        return {"_gain": gain, "_small": F.coalesce(small, F.lit(False)).cast("int")}

    target_rows = settle(rounds, keys, target_rows)
    rows = rolling(rounds, list(keys), [order], 1, build, target_rows)
    rows = running(rows, list(keys), [order], {"_late": ("max", F.col("_small"))}, target_rows)
    late = F.col("_late") == 1
    return rows.withColumns({
        "improvement": F.col("_gain"), "phase": F.when(late, "late").otherwise("early"),
        "interval_s": F.when(late, LATE_S).otherwise(EARLY_S),
    }).drop("_gain", "_small", "_late")


def round_monitor(updates: DataFrame, min_clients: int = 2) -> DataFrame:
    """Waiting updates and clients per round, whether it can run, minutes to the next round."""
    rows = updates.groupBy("round").agg(
        F.count_distinct("client_id").alias("clients_seen"),
        F.count(F.lit(1)).alias("updates_received"),
        F.max("elapsed_s").alias("_elapsed"), F.max("interval_s").alias("_interval"))
    return rows.select(
        "round", "clients_seen", "updates_received",
        (F.col("clients_seen") >= min_clients).alias("ready"),
        F.greatest(F.lit(0.0), (F.col("_interval") - F.col("_elapsed")) / 60.0)
        .alias("minutes_to_next"))


def save_round(weights: DataFrame, path: str) -> None:
    """Append averaged weights, one folder per round."""
    weights.write.mode("append").partitionBy("round").parquet(path)


def load_latest(spark: SparkSession, path: str) -> DataFrame:
    """Weights of the highest round number (a number, not a name: 10 comes after 9)."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("round")).first()[0]
    return table.where(F.col("round") == newest)


def checkpoint_state(weights: DataFrame, states: DataFrame, by: Sequence[str],
                     min_norm: float = 0.01, min_threshold: float = 1e-4) -> DataFrame:
    """Which client checkpoints may be restored, and with which threshold."""
    norms = layer_norms(weights, by).groupBy(*by).agg(F.avg("norm").alias("mean_norm"))
    healthy = F.col("mean_norm") >= min_norm
    usable = healthy & F.coalesce(F.col("calibrated") & (F.col("threshold") > min_threshold),
                                  F.lit(False))
    return states.join(norms, list(by)).select(
        *by, "mean_norm", healthy.alias("restored"), usable.alias("is_calibrated"),
        F.when(usable, F.col("threshold")).alias("threshold"))


class SendPolicy:
    """When a client sends its weights; one instance holds one client's state."""

    def __init__(self, base_s: float = 3600.0, min_s: float = 900.0):
        self.base_s, self.min_s = base_s, min_s
        self.interval = base_s
        self.last_time = None
        self.reference = None
        self.loss = None
        self.sent_round = None

    def saved(self) -> tuple:
        kept = None if self.reference is None else [float(x) for x in self.reference]
        return self.interval, self.last_time, kept, self.loss, self.sent_round

    def restore(self, interval, last_time, reference, loss, sent_round) -> None:
        self.interval, self.last_time, self.loss = interval, last_time, loss
        self.reference = None if reference is None else np.asarray(reference)
        self.sent_round = sent_round

    def step(self, time_s: float, round_no: int, weights: np.ndarray, loss: float):
        """(send, reason) for one training cycle; a send becomes the new reference."""
        if self.last_time is None:
            self.last_time = time_s
        send, reason = self.decide(time_s, round_no, weights, loss)
        if send:
            self.reference, self.loss = weights, loss
            self.last_time, self.sent_round = time_s, round_no
        return send, reason

    def decide(self, time_s, round_no, weights, loss):
        """(send, reason) by the rule alone; a back-off is noted, a send is not."""
        if round_no == self.sent_round:
            return False, "already_sent"
        if self.reference is None:
            return True, "initial"
        waited = time_s - self.last_time
        drift = float(np.sqrt(np.mean((weights - self.reference) ** 2)))
        change = np.inf if self.loss is None else abs(loss - self.loss) / max(self.loss, 1e-8)
        if waited > self.min_s and drift > DIVERGENCE_LIMIT:
            return True, "weight_divergence"
        if waited > self.min_s and change > LOSS_LIMIT:
            self.interval = self.base_s
            return True, "concept_drift"
        if waited < self.interval:
            return False, "waiting"
        if drift > STABLE_DIVERGENCE:
            return True, "scheduled"
        self.interval = min(self.interval * BACKOFF, self.base_s * BACKOFF_CEILING)
        self.last_time = time_s
        return False, "skipped_stable"


def send_decisions(cycles: DataFrame, base_s: float = 3600.0, min_s: float = 900.0) -> DataFrame:
    """Send decision of every cycle, in order per client.

    Input: client_id, time_s, round, weights array<double>, loss. The rule is recursive (what
    was sent changes what follows), so a client's cycles are walked in order; they stream
    through in Arrow batches and only the current state is held.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, policy = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if policy is None or row.client_id != client:
                    client, policy = row.client_id, SendPolicy(base_s, min_s)
                out.append(policy.step(row.time_s, row.round, np.asarray(row.weights), row.loss))
            kept = pdf[["client_id", "time_s", "round"]].copy()
            kept["send"] = [s for s, _ in out]
            kept["reason"] = [r for _, r in out]
            yield kept

    ordered = cycles.select("client_id", "time_s", "round", "weights", "loss").repartition(
        "client_id").sortWithinPartitions("client_id", "time_s", "round")
    kinds = dict(cycles.dtypes)
    schema = (f"client_id {kinds['client_id']}, time_s {kinds['time_s']}, "
              f"round {kinds['round']}, send boolean, reason string")
    return ordered.mapInPandas(walk, schema)
