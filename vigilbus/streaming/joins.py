"""Joins of two streams by time: attack intervals to rows, and the latest earlier row of a feed.

Each stream has a delay of its own. Spark's watermark is the smaller of the two (the policy ``min``), so
a row is final only when both streams have passed it. Rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilbus.streaming.stateful import use_rocks_state


def label_by_intervals(rows: DataFrame, log: DataFrame, slot_s: int = 600, row_delay: str = "1 minute",
                       log_delay: str = "1 hour", key: str = "vehicle_id") -> DataFrame:
    """Mark rows with start <= ts < end for any interval of the key, as the batch form does.

    ``rows``: key, ts, seq and others; ``log``: key, start_time, end_time, attack_type. An interval is cut
    at multiples of ``slot_s``, and a piece meets the rows of its slot only: an outer join on (key, slot)
    with a range, whose state ends with the slot, and which spreads a busy vehicle over its slots. Rows
    without a piece come out when the watermark has passed them. Of several intervals around a row,
    the one that reaches furthest names it; they are put together per row in a second stateful step.
    ``log_delay`` covers how long after the start of a slot an interval may become known.
    """
    length = slot_s * 1_000_000
    slot = F.floor(F.unix_micros("ts") / length).cast("long")
    left = rows.withWatermark("ts", row_delay).withColumn("_slot", slot)
    first = F.floor(F.unix_micros("start_time") / length).cast("long")
    last = F.floor((F.unix_micros("end_time") - 1) / length).cast("long")
    pieces = log.where("start_time < end_time").select(
        F.col(key).alias("_key"), "start_time", "end_time", "attack_type",
        F.explode(F.sequence(first, last)).alias("_piece"))
    begin = F.greatest(F.unix_micros("start_time"), F.col("_piece") * length)
    right = pieces.select(
        "_key", "_piece", F.timestamp_micros(begin).alias("_from"),
        F.col("end_time").alias("_to"), F.col("attack_type").alias("_type"),
    ).withWatermark("_from", log_delay)
    inside = (
        (F.col(key) == F.col("_key")) & (F.col("_slot") == F.col("_piece"))
        & (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))
        # Says what the slots imply, so that Spark can end the pieces' state.
        & (F.col("ts") < F.col("_from") + F.make_dt_interval(secs=F.lit(slot_s))))
    met = left.join(right, inside, "left_outer")
    whole = [c for c in rows.columns if c not in (key, "ts", "seq")]
    us = F.unix_micros("ts").alias("_us")  # a group has one event time only, that of the window
    labelled = met.groupBy(F.window("ts", f"{slot_s} seconds").alias("_w"), key, "seq", us).agg(
        F.max(F.when(F.col("_to").isNotNull(), F.struct("_to", "_type"))).alias("_far"),
        *[F.any_value(c).alias(c) for c in whole])
    return labelled.withColumn("ts", F.timestamp_micros("_us")).select(
        *rows.columns, F.col("_far").isNotNull().alias("in_attack"),
        F.col("_far._type").alias("attack_type"))


class AsOf(StatefulProcessor):
    """Rows of both feeds wait in time order until the watermark has passed them."""

    def __init__(self, left: Sequence[tuple[str, str]], right: Sequence[tuple[str, str]]):
        self.left, self.right = list(left), list(right)
        self.carried = ["us", "seq", "side", *[f"l_{n}" for n, _ in left], *[f"r_{n}" for n, _ in right]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f"l_{n} {k}" for n, k in self.left] + [f"r_{n} {k}" for n, k in self.right]
        self.pending = handle.getListState(
            "pending", ", ".join(["us long", "seq long", "side int", *fields]))
        self.known = handle.getMapState("known", "name string", ", ".join(
            f"{n} {k}" for n, k in self.right))
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        self._wait(pdf[self.carried])
        return iter(())

    def _wait(self, pdf: pd.DataFrame) -> None:
        plain = pdf.astype(object).where(pdf.notna(), None)
        self.pending.appendList(list(plain.itertuples(index=False, name=None)))
        first = int(pdf["us"].min()) // 1000 + 1
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or first < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.due.update((first,))
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.pending.get()), columns=self.carried)
        self.pending.clear()
        self.due.clear()
        ripe = rows["us"] < closed
        if not ripe.all():
            self._wait(rows[~ripe])
        # At equal times a row of the right feed counts as earlier.
        ready = rows[ripe].sort_values(["us", "side", "seq"], ignore_index=True)
        names = [n for n, _ in self.right]
        before = self.known.getValue(("last",)) if self.known.containsKey(("last",)) else None
        values = ready[[f"r_{n}" for n in names]].astype(object)
        if before is not None:
            values.loc[-1] = list(before)
            values = values.sort_index()
        filled = values.where(values.notna(), None).ffill().tail(len(ready)).reset_index(drop=True)
        if not ready.empty:
            last = filled.iloc[-1]
            if last.notna().any():
                self.known.updateValue(("last",), tuple(None if pd.isna(v) else v for v in last))
        kept = ready["side"] == 1
        out = pd.DataFrame({"vehicle_id": key[0], "us": ready["us"], "seq": ready["seq"]})
        for name, _ in self.left:
            out[name] = ready[f"l_{name}"]
        for name in names:
            out[name] = filled[f"r_{name}"]
        yield out[kept]

    def close(self) -> None:
        pass


def asof_merge(left: DataFrame, right: DataFrame, columns: Sequence[str],
               left_delay: str, right_delay: str) -> DataFrame:
    """Attach to each left row the latest right values at or before it.

    Both feeds carry vehicle_id, ts, us, seq. Rows come out once both feeds' delays have passed them.
    """
    use_rocks_state(left.sparkSession)
    kinds = dict(left.dtypes)
    own = [(n, k) for n, k in left.dtypes if n not in ("vehicle_id", "ts", "us", "seq")]
    other = [(n, dict(right.dtypes)[n]) for n in columns]
    place = ["vehicle_id", "ts", "us", "seq"]
    first = left.withWatermark("ts", left_delay).select(
        *place, F.lit(1).alias("side"), *[F.col(n).alias(f"l_{n}") for n, _ in own],
        *[F.lit(None).cast(k).alias(f"r_{n}") for n, k in other])
    second = right.withWatermark("ts", right_delay).select(
        *place, F.lit(0).alias("side"), *[F.lit(None).cast(k).alias(f"l_{n}") for n, k in own],
        *[F.col(n).alias(f"r_{n}") for n, _ in other])
    output = ", ".join([f"vehicle_id {kinds['vehicle_id']}", "us long", "seq long",
                        *[f"{n} {k}" for n, k in [*own, *other]]])
    return first.unionByName(second).groupBy("vehicle_id").transformWithStateInPandas(
        AsOf(own, other), output, "Append", "EventTime")
