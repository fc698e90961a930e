"""Stateful stream operators on arbitrary state: lists, maps, values, timers and initial state.

The processors run on ``transformWithStateInPandas`` with a RocksDB state store. Rows of one key and
micro-batch are sorted by (time, seq) before use, since Spark does not order them. The trigger's file
limit bounds how many rows that is.

With a ``delay`` the stream (which then also carries ``ts``) gets a watermark: rows behind it are
dropped, and an event-time timer removes the state of a key that has been silent for ``keep_s``.
Without one, state stays, or with ``ttl_s`` its entries expire that were not written for so many
seconds of processing time. A stream with a TTL wants empty micro-batches for ever, so it does not end
by itself when all data available now are done. Rows that are older than what a key has already
emitted are late and dropped where order matters, with or without a watermark.

``initial`` is a batch table from which the state starts, in the first micro-batch of a new
checkpoint: a stream that is moved to another cluster goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilbus.operators.federated import SendPolicy
from vigilbus.schema import STATE_DEFAULTS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a growing result that are handed over at a time.
PIECE = 10_000
#: After all steps and sequence numbers.
NEVER = 2**63 - 1


def use_rocks_state(spark: SparkSession) -> None:
    """Streams started in the session from now on keep their state in RocksDB."""
    spark.conf.set(PROVIDER, ROCKS)


def _sorted(batches: Iterator[pd.DataFrame], by: Sequence[str] = ("us", "seq")) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(by), ignore_index=True)


def _after(pdf: pd.DataFrame, last: tuple | None) -> pd.DataFrame:
    """Rows after the last one that the key has emitted."""
    if last is None:
        return pdf
    us, seq = last[0], last[1]
    return pdf[(pdf["us"] > us) | ((pdf["us"] == us) & (pdf["seq"] > seq))].reset_index(drop=True)


@dataclass(frozen=True)
class Lifetime:
    """How long state lives; see the module text."""

    delay: str | None = None
    keep_s: float = 86_400.0
    ttl_s: float | None = None

    def __post_init__(self) -> None:
        if self.delay and self.ttl_s:
            raise ValueError("state expires by watermark or by TTL, not both")

    @property
    def mode(self) -> str:
        return "EventTime" if self.delay else "ProcessingTime" if self.ttl_s else "None"

    @property
    def ttl_ms(self) -> int | None:
        return int(self.ttl_s * 1000) if self.ttl_s else None


class Processor(StatefulProcessor):
    """Keeps the position of a key's last row and, on a watermark, the one timer of the key."""

    def __init__(self, life: Lifetime):
        self.timed, self.ttl = life.delay is not None, life.ttl_ms
        self.keep_ms = int(life.keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, seq long, until long", self.ttl)

    def close(self) -> None:
        pass

    def position(self) -> tuple | None:
        """(us, seq, until) of the last row of the key, if it has state."""
        return self.last.get() if self.last.exists() else None

    def advance(self, us: int, seq: int, before: tuple | None, timer_values) -> None:
        """Note the last row; the key's one timer moves on with it."""
        until = us // 1000 + self.keep_ms
        if self.timed:
            until = max(until, timer_values.getCurrentWatermarkInMs() + 1)
            if before is not None and before[2] != until:
                self.handle.deleteTimer(before[2])
            if before is None or before[2] != until:
                self.handle.registerTimer(until)
        self.last.update((int(us), int(seq), until))

    def clear(self) -> None:
        self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())


def _run(stream: DataFrame, by: Sequence[str], processor: StatefulProcessor, output: str,
         life: Lifetime, initial: DataFrame | None) -> DataFrame:
    use_rocks_state(stream.sparkSession)
    rows = stream.withWatermark("ts", life.delay) if life.delay else stream
    start = None if initial is None else initial.groupBy(*by)
    return rows.groupBy(*by).transformWithStateInPandas(
        processor, output, "Append", life.mode, start)


class RateInBlock(Processor):
    """Trailing counts of the signals of one (vehicle, time block).

    ``times`` lists the messages that reach into the block. It is only appended to; the timer of the
    block's end, or the TTL, removes it as a whole.
    """

    def __init__(self, span_us: int, block_us: int, life: Lifetime):
        super().__init__(life)
        self.span_us, self.block_us = span_us, block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "signal string, us long", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(key, initialState, False)

    def _add(self, key, new: pd.DataFrame, known: bool) -> None:
        self.times.appendList(list(zip(new["signal"], new["us"].tolist(), strict=True)))
        if self.timed and not known:
            self.handle.registerTimer((key[1] + 1) * self.block_us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        old = pd.DataFrame(list(self.times.get()), columns=["signal", "us"])
        self._add(key, new, len(old) > 0)
        every = new[["signal", "us"]] if old.empty else pd.concat([old, new[["signal", "us"]]])
        us, code = every["us"].to_numpy("int64"), pd.factorize(every["signal"])[0]
        own = new[new["own"].to_numpy(bool)]
        mine = np.concatenate([np.zeros(len(old), bool), new["own"].to_numpy(bool)])
        rate = np.zeros(len(every), dtype="int64")
        for c in np.unique(code[mine]):
            times, places = np.sort(us[code == c]), mine & (code == c)
            rate[places] = np.searchsorted(times, us[places], "right") - np.searchsorted(
                times, us[places] - self.span_us, "right")
        rate = rate[mine]
        yield pd.DataFrame({
            "vehicle_id": key[0], "signal": own["signal"], "seq": own["seq"], "rate": rate})

    def clear(self) -> None:
        self.times.clear()


def _in_blocks(rows: DataFrame, span_us: int, block_us: int) -> DataFrame:
    """Rows under their time block, and once more under the next if they reach into it."""
    block = F.floor(F.col("us") / block_us).cast("long")
    reach = F.floor((F.col("us") + span_us - 1) / block_us).cast("long")
    home = F.struct(block.alias("block"), F.lit(True).alias("own"))
    halo = F.struct(reach.alias("block"), F.lit(False).alias("own"))
    places = F.when(reach > block, F.array(home, halo)).otherwise(F.array(home))
    return rows.withColumn("_p", F.explode(places)).select("*", "_p.*").drop("_p")


def exact_rate(stream: DataFrame, span_us: int, delay: str | None = None,
               ttl_s: float | None = None, block_us: int | None = None,
               initial: DataFrame | None = None) -> DataFrame:
    """Messages of the (vehicle, signal) in the trailing span, for every row.

    Input: vehicle_id, signal, us, seq; ``initial``: vehicle_id, signal, us of rows before the stream.
    Time is cut into blocks of ``block_us`` (sixteen spans unless given, one at least). A row is counted
    under its vehicle's block and, from the last span of a block, under the next one as well. So the rows of one
    busy vehicle go to as many tasks as they have blocks, and a list never holds more than a block and
    a span. A watermark removes a block's list once it has passed the block.
    """
    life = Lifetime(delay, ttl_s=ttl_s)
    block_us = block_us or 16 * span_us
    if block_us < span_us:
        raise ValueError("a block must be as long as the span")
    kind = dict(stream.dtypes)["vehicle_id"]
    start = None if initial is None else _in_blocks(initial, span_us, block_us).drop("own")
    return _run(_in_blocks(stream, span_us, block_us), ["vehicle_id", "block"],
                RateInBlock(span_us, block_us, life),
                f"vehicle_id {kind}, signal string, seq long, rate long", life, start)


def _last_known(pdf: pd.DataFrame, names: Sequence[str], before: dict) -> pd.DataFrame:
    """Value of every signal at each of the sorted rows."""
    return pd.DataFrame({
        n: pdf["value"].where(pdf["signal"] == n).ffill().fillna(before[n]) for n in names})


class SignalState(Processor):
    """A vehicle's last known value per signal, as a map."""

    def __init__(self, defaults: dict[str, float], life: Lifetime):
        super().__init__(life)
        self.defaults, self.names = defaults, list(defaults)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "signal string", "value double", self.ttl)

    def values(self) -> dict[str, float]:
        return self.defaults | {k[0]: v[0] for k, v in self.known.iterator()}

    def learn(self, before: dict, now: dict) -> None:
        for name, value in now.items():
            if value != before[name]:
                self.known.updateValue((name,), (float(value),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values(["us", "seq"], ignore_index=True)
        before = self.values()
        self.learn(before, _last_known(rows, self.names, before).iloc[-1].to_dict())
        here = self.position()
        end = (int(rows["us"].iloc[-1]), int(rows["seq"].iloc[-1]))
        if here is None or here[:2] < end:
            self.advance(*end, here, timerValues)

    def clear(self) -> None:
        super().clear()
        self.known.clear()


class ChangedState(SignalState):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        here = self.position()
        pdf = _after(_sorted(rows), here)
        if pdf.empty:
            return
        before = self.values() if here else dict(self.defaults)
        wide = _last_known(pdf, self.names, before)
        previous = wide.shift(1)
        previous.iloc[0] = [before[n] for n in self.names] if here else np.nan
        changed = (wide != previous).any(axis=1)
        self.learn(before, wide.iloc[-1].to_dict())
        self.advance(pdf["us"].iloc[-1], pdf["seq"].iloc[-1], here, timerValues)
        out = wide[changed]
        out.insert(0, "seq", pdf["seq"][changed])
        out.insert(0, "vehicle_id", key[0])
        yield out


def changed_state(stream: DataFrame, defaults: dict[str, float] | None = None,
                  delay: str | None = None, keep_s: float = 86_400.0, ttl_s: float | None = None,
                  initial: DataFrame | None = None) -> DataFrame:
    """Last-known state of every signal, emitted only when it differs from what was sent.

    Input and ``initial``: vehicle_id, us, seq, signal, value; of the initial rows the newest of each
    signal is enough.
    """
    defaults = dict(defaults or STATE_DEFAULTS)
    kind = dict(stream.dtypes)["vehicle_id"]
    values = ", ".join(f"{n} double" for n in defaults)
    life = Lifetime(delay, keep_s, ttl_s)
    return _run(stream, ["vehicle_id"], ChangedState(defaults, life),
                f"vehicle_id {kind}, seq long, {values}", life, initial)


class StateGrid(Processor):
    """State of the vehicles of a share at each time step, also at steps without a row.

    Rows wait in ``pending`` until the watermark has passed them, so that late ones take their place.
    ``fleet`` holds the next step, the last row's time and the known values of the vehicles whose steps
    have begun. The share's one timer stands at the first of its vehicles' next steps. It fires in the
    first micro-batch whose watermark is beyond, whether or not there were rows, and gives all steps
    up to there. All of it is kept as columns, an entry for each row or vehicle: a share takes the same
    few calls to the state store whatever its number of vehicles.
    """

    columns = "vehicle", "us", "seq", "signal", "value"

    def __init__(self, defaults: dict[str, float], step_us: int, life: Lifetime, bounded: bool):
        super().__init__(life)
        self.defaults, self.names = defaults, list(defaults)
        self.step_us, self.bounded = step_us, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState(
            "pending", "vehicle array<string>, us array<long>, seq array<long>, signal array<string>, "
            "value array<double>")
        self.fleet = handle.getValueState(
            "fleet", "vehicle array<string>, point array<long>, us array<long>, "
            "known map<string, array<double>>")
        self.next = handle.getValueState("next", "point long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._wait(initialState)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._wait(pd.concat(list(rows), ignore_index=True))
        return iter(())

    def _wait(self, pdf: pd.DataFrame) -> None:
        self.pending.appendList([tuple(pdf[c].tolist() for c in self.columns)])
        first = -(-int(pdf["us"].min()) // self.step_us)
        old = self.next.get()[0] if self.next.exists() else None
        if old is None or first < old:
            if old is not None:
                self.handle.deleteTimer(self._due(old))
            self._stand_at(first)

    def _due(self, point: int) -> int:
        """First millisecond at or after a step."""
        return -(-point * self.step_us // 1000)

    def _stand_at(self, point: int) -> None:
        self.next.update((point,))
        self.handle.registerTimer(self._due(point))

    def _waiting(self) -> dict[str, np.ndarray]:
        """Columns of the pending rows."""
        pieces = list(self.pending.get())
        kinds = object, "int64", "int64", object, float
        return {c: np.array([x for piece in pieces for x in piece[i]], kinds[i])
                for i, c in enumerate(self.columns)}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, keep_us = self.step_us, self.keep_ms * 1000
        closed_us = timerValues.getCurrentWatermarkInMs() * 1000  # steps before it are final
        end = -(-closed_us // step)  # first step that is still open
        rows = self._waiting()
        old = self.fleet.get() if self.fleet.exists() else ([], [], [], {})
        begun = len(old[0])
        code, vehicles = _codes(pd.Series([*old[0], *rows["vehicle"]], dtype=object))
        who, size = code[begun:], len(vehicles)  # the first codes are the fleet's

        point = np.full(size, NEVER)
        point[:begun] = old[1]
        new = who >= begun
        np.minimum.at(point, who[new], -(-rows["us"][new] // step))
        due = point <= closed_us // step
        ripe = rows["us"] < closed_us
        take = np.flatnonzero(ripe & due[who])
        take = take[np.lexsort((rows["seq"][take], rows["us"][take], who[take]))]
        last = np.zeros(size, "int64")
        last[:begun] = old[2]
        np.maximum.at(last, who[take], rows["us"][take])
        silent = due & (last + keep_us < closed_us) & self.bounded
        silent[who[~ripe]] = False
        stop = np.where(silent, np.minimum(end, (last + keep_us) // step + 1), end)

        # The state before and the ripe rows of one vehicle after the other, each with its first step.
        live = np.flatnonzero(due)
        owner = np.concatenate([live, who[take]])
        since = np.concatenate([point[live], -(-rows["us"][take] // step)])
        turn = np.argsort(owner, kind="stable")
        owner, since = owner[turn], since[turn]
        known, table = {}, {}
        for n in self.names:
            known[n] = np.full(size, float(self.defaults[n]))
            known[n][:begun] = old[3].get(n, known[n][:begun])
            told = np.where(rows["signal"][take] == n, rows["value"][take], np.nan)
            cells = np.concatenate([known[n][live], told])[turn]
            given = np.concatenate([np.ones(len(live), bool), ~np.isnan(told)])[turn]
            table[n] = cells[np.maximum.accumulate(np.where(given, np.arange(len(cells)), 0))]
            known[n][live] = table[n][np.searchsorted(owner, live, "right") - 1]

        # The result's rows are numbered through; ``place`` is the first that a table row applies to.
        count = np.where(due, np.maximum(stop - point, 0), 0)
        begin = np.cumsum(count) - count
        place = begin[owner] + np.clip(since - point[owner], 0, count[owner])
        for low in range(0, int(count.sum()), PIECE):
            number = np.arange(low, min(low + PIECE, int(count.sum())))
            at = np.searchsorted(place, number, "right") - 1
            of = owner[at]
            yield pd.DataFrame({
                "vehicle_id": vehicles[of], "grid_us": (point[of] + number - begin[of]) * step,
                **{n: table[n][at] for n in self.names}})

        point[due] = end
        rest = np.delete(np.arange(len(who)), take)
        if len(rest):
            self.pending.put([tuple(rows[c][rest].tolist() for c in self.columns)])
        else:
            self.pending.clear()
        stay = (due | (np.arange(size) < begun)) & ~silent
        if stay.any():
            self.fleet.update((vehicles[stay].tolist(), point[stay].tolist(), last[stay].tolist(),
                               {n: known[n][stay].tolist() for n in self.names}))
        else:
            self.fleet.clear()
        ahead = point[~silent]
        if len(ahead):
            self._stand_at(int(ahead.min()))
        else:
            self.next.clear()

    def clear(self) -> None:
        self.next.clear()
        self.pending.clear()
        self.fleet.clear()


def _codes(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Number of each name in order of appearance, and the names; null is one of them."""
    codes, found = pd.factorize(names.to_numpy(object), use_na_sentinel=False)
    return codes, np.array([n if isinstance(n, str) else None for n in found], object)


def _in_shares(rows: DataFrame, shares: int) -> DataFrame:
    """Rows that have a time, with their vehicle's share; its id is text here, a null number comes last."""
    vehicle = F.col("vehicle_id").cast("string")
    return rows.where("us IS NOT NULL").withColumns({
        "vehicle": vehicle, "share": F.pmod(F.xxhash64(vehicle), F.lit(shares)).cast("int"),
        "seq": F.coalesce("seq", F.lit(NEVER))}).drop("vehicle_id")


def state_grid(stream: DataFrame, step_us: int, delay: str, defaults: dict[str, float] | None = None,
               keep_s: float | None = None, initial: DataFrame | None = None,
               shares: int = 1024) -> DataFrame:
    """State of every signal at each multiple of ``step_us`` from a vehicle's first row on.

    Input and ``initial``: ts, vehicle_id, us, seq, signal, value. A step is given once the watermark has
    passed it; a silent vehicle goes on with its last state, for ``keep_s`` at most if that is given.
    Then it starts anew. State is kept for ``shares`` of the vehicles, dealt by hash: one share's rows
    and vehicles must fit a task's memory. A checkpoint goes on with the number it began with.
    """
    defaults = dict(defaults or STATE_DEFAULTS)
    kind = dict(stream.dtypes)["vehicle_id"]
    values = ", ".join(f"{n} double" for n in defaults)
    life = Lifetime(delay, keep_s or 0)
    start = None if initial is None else _in_shares(initial, shares)
    out = _run(_in_shares(stream, shares), ["share"],
               StateGrid(defaults, step_us, life, keep_s is not None),
               f"vehicle_id string, grid_us long, {values}", life, start)
    return out.withColumn("vehicle_id", F.col("vehicle_id").cast(kind))


class OnlineWindows(Processor):
    """Windows of consecutive rows of a vehicle; ``tail`` lists its last length-1 rows."""

    def __init__(self, features: int, length: int, life: Lifetime):
        super().__init__(life)
        self.features, self.length = features, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tail = handle.getListState("tail", "v array<double>", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._slide(initialState.sort_values(["us", "seq"], ignore_index=True), timerValues)

    def _slide(self, pdf: pd.DataFrame, timer_values) -> tuple[np.ndarray, np.ndarray]:
        """(sequence numbers, flattened windows) that end in these rows."""
        none = np.array([], dtype=int), np.empty((0, self.length * self.features))
        here = self.position()
        pdf = _after(pdf, here)
        if pdf.empty:
            return none
        old = [list(t[0]) for t in self.tail.get()] if here else []
        rows = np.vstack([np.array(old, float).reshape(-1, self.features),
                          np.stack(pdf["v"].to_numpy()).astype(float)])
        self.tail.put([(r,) for r in rows[len(rows) - min(len(rows), self.length - 1):].tolist()])
        self.advance(pdf["us"].iloc[-1], pdf["seq"].iloc[-1], here, timer_values)
        first = max(0, self.length - 1 - len(old))
        if first >= len(pdf):
            return none
        windows = np.lib.stride_tricks.sliding_window_view(rows, self.length, axis=0)
        flat = windows.transpose(0, 2, 1).reshape(len(windows), -1)
        return pdf["seq"].to_numpy()[first:], flat

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, flat = self._slide(_sorted(rows), timerValues)
        yield self.result(key, seq, flat)

    def result(self, key, seq: np.ndarray, flat: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"vehicle_id": key[0], "end_seq": seq, "flat": list(flat)})

    def clear(self) -> None:
        super().clear()
        self.tail.clear()


class OnlineScores(OnlineWindows):
    """The weights travel with the processor: stateful processors can't read broadcast variables."""

    def __init__(self, net, params, life: Lifetime):
        super().__init__(net.features, net.length, life)
        self.net, self.params = net, params

    def result(self, key, seq: np.ndarray, flat: np.ndarray) -> pd.DataFrame:
        score = self.net.scores(self.params, flat) if len(flat) else np.array([])
        return pd.DataFrame({"vehicle_id": key[0], "end_seq": seq, "score": score})


def online_windows(stream: DataFrame, features: int, length: int = 20, delay: str | None = None,
                   keep_s: float = 86_400.0, ttl_s: float | None = None,
                   initial: DataFrame | None = None) -> DataFrame:
    """A flattened window for every row from the ``length``-th on.

    Input and ``initial``: vehicle_id, us, seq, v array<double>; windows that end in an initial row are
    not given again.
    """
    kind = dict(stream.dtypes)["vehicle_id"]
    life = Lifetime(delay, keep_s, ttl_s)
    return _run(stream, ["vehicle_id"], OnlineWindows(features, length, life),
                f"vehicle_id {kind}, end_seq long, flat array<double>", life, initial)


def online_scores(stream: DataFrame, net, params, delay: str | None = None,
                  keep_s: float = 86_400.0, ttl_s: float | None = None,
                  initial: DataFrame | None = None) -> DataFrame:
    """Reconstruction error of every window as it completes; the size of the weights is the model's."""
    kind = dict(stream.dtypes)["vehicle_id"]
    life = Lifetime(delay, keep_s, ttl_s)
    return _run(stream, ["vehicle_id"], OnlineScores(net, params, life),
                f"vehicle_id {kind}, end_seq long, score double", life, initial)


def send_decisions(stream: DataFrame, base_s: float = 3600.0, min_s: float = 900.0) -> DataFrame:
    """Send decision for each training cycle as it arrives; the policy is the client's state.

    Input: client_id, time_s, round, weights array<double>, loss.
    """
    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState):
        policy = SendPolicy(base_s, min_s)
        if state.exists:
            policy.restore(*state.get)
        pdf = _sorted(batches, ("time_s", "round"))
        made = [policy.step(r.time_s, r.round, np.asarray(r.weights), r.loss)
                for r in pdf.itertuples(index=False)]
        state.update(policy.saved())
        yield pd.DataFrame({
            "client_id": key[0], "time_s": pdf["time_s"], "round": pdf["round"],
            "send": [s for s, _ in made], "reason": [r for _, r in made]})

    kinds = dict(stream.dtypes)
    return stream.groupBy("client_id").applyInPandasWithState(
        decide, f"client_id {kinds['client_id']}, time_s double, round int, send boolean, reason string",
        "interval double, last_time double, reference array<double>, loss double, sent_round int",
        "append", GroupStateTimeout.NoTimeout)
