"""What a client does at the end of each training cycle: roll back, send, recalibrate.

Rollback and improvement depend on the losses alone and come from the block-wise helpers, so they hold
for histories of any length. The send rule is recursive: what was sent changes what follows. A
client's events are walked in order for it, in Arrow batches, with the current state only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.operators import federated as fed

ORDER = ["time_s", "event"]
OUT = "rolled_back boolean, improving boolean, send boolean, reason string, calibrated boolean"


class Cycle:
    """State of one client between its events."""

    def __init__(self, base_s: float, min_s: float):
        self.policy = fed.SendPolicy(base_s, min_s)
        self.requested, self.calibrated, self.loss = False, False, None

    def _store(self, row) -> None:
        self.policy.reference, self.policy.loss = np.asarray(row.weights), self.loss
        self.policy.last_time = row.time_s

    def take(self, row) -> tuple[bool, str, bool]:
        """(send, reason, calibrated) after an event."""
        policy = self.policy
        if policy.last_time is None:
            policy.last_time = row.time_s
        if row.kind == "global":
            # A new global model is the new reference, and the threshold no longer fits.
            self._store(row)
            self.calibrated = False
            return False, "global_model", False
        self.loss = row.loss
        self.requested |= bool(row.requested)
        if row.rolled_back:  # ends the cycle; a request waits for the next one
            return False, "rolled_back", self.calibrated
        if self.requested:
            send, reason = True, "server_request"
        else:
            send, reason = policy.decide(row.time_s, row.round, np.asarray(row.weights), row.loss)
            if send and not row.improving:
                send, reason = False, "not_improving"
        self.requested, self.calibrated = False, True
        if send:
            self._store(row)
            policy.sent_round = row.round
        return send, reason, True


def cycle_decisions(events: DataFrame, base_s: float = 3600.0, min_s: float = 900.0,
                    patience: int = fed.PATIENCE, target_rows: float | None = None) -> DataFrame:
    """Outcome of every event of every client.

    Input: client_id, time_s, event (its number), kind (cycle or global), round, weights array<double>,
    loss and requested (the server asked for a send since the cycle before); the last two of cycles
    only. A rollback ends a cycle. A request is met whatever the rule says. Else the rule decides, and a
    client whose loss has risen over three cycles doesn't send. ``calibrated`` holds after the event.
    """
    kept = ["client_id", "time_s", "event", "kind", "round", "loss", "requested"]
    cycles = events.where("kind = 'cycle'").select("client_id", *ORDER, "loss")
    judged = fed.improving(fed.rollback(cycles, order=ORDER, patience=patience, target_rows=target_rows),
                           order=ORDER, target_rows=target_rows)
    flags = judged.select("client_id", *ORDER, F.col("rollback").alias("rolled_back"), "improving")
    rows = events.select(*kept, "weights").join(flags, ["client_id", *ORDER], "left").fillna(
        False, ["requested", "rolled_back"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, None
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False):
                if state is None or row.client_id != client:
                    client, state = row.client_id, Cycle(base_s, min_s)
                made.append(state.take(row))
            out = pdf[["client_id", "time_s", "event", "kind", "round", "rolled_back", "improving"]].copy()
            out["send"], out["reason"], out["calibrated"] = (
                [m[i] for m in made] for i in range(3))
            yield out

    kinds = dict(events.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("client_id", "time_s", "event", "kind", "round"))
    return rows.repartition("client_id").sortWithinPartitions("client_id", *ORDER).mapInPandas(
        walk, f"{schema}, {OUT}")
