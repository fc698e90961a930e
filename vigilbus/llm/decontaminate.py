"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 13 consecutive words of a benchmark item is a test string (an item of fewer words
is one window). Words are numbered by the windows' vocabulary, so a block of two words indexes the
SHIFT table: a block that no window holds lets the search skip a whole window's length. A shift of
zero leads to the bucket of windows with that last block, whose words are compared one by one.

The benchmark is cut into blocks of items of bounded size. Each block is one pass inside the same
scan of the documents, so the tables sent to the executors stay bounded, and documents never
shuffle.

Defined cases: a null or empty text has no words and is clean; items without words have no windows;
a null item id is reported as the empty string; equal item ids count once; repeated documents are
judged one by one; an empty benchmark leaves every document clean; input columns called like an
added one are replaced.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.llm.columns import boxed, unboxed, without

WINDOW = 13
#: Benchmark text, in bytes, whose tables are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Words a lane of the lockstep search is responsible for.
LANE = 512
#: Window comparisons held at once.
COMPARED = 200_000
_TABLE_BITS = 16
_FOUND = "n_words long, hit_runs array<int>, hit_items array<string>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hit_runs", pa.list_(pa.int32())),
                          ("hit_items", pa.list_(pa.string()))])
ADDED = ("n_words", "hit_runs", "hit_items", "n_hit", "n_items", "contaminated")

# Lower-case A-Z, keep digits, letters and all non-ASCII bytes, turn the rest into blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WindowSearch:
    """Wu-Manber tables for windows of one length, as rows of word numbers."""

    def __init__(self, windows: np.ndarray) -> None:
        self.length = windows.shape[1]
        self.block = min(2, self.length)
        keys = self._key(windows[:, -self.block], windows[:, -1])
        order = np.argsort(keys, kind="stable")
        self.order, self.windows, self.keys = order, windows[order], keys[order]
        self.shift = np.full(1 << _TABLE_BITS, self.length - self.block + 1, np.int32)
        for end in range(self.block - 1, self.length):
            at = self._key(windows[:, end - self.block + 1], windows[:, end])
            np.minimum.at(self.shift, at, self.length - 1 - end)

    @staticmethod
    def _key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions where the last block of some window ends; all lanes jump in step."""
        starts = np.arange(self.length - 1, len(ids), LANE)
        stops = np.minimum(starts + LANE, len(ids))
        at, found = starts, []
        while len(at):
            jump = self.shift[self._key(ids[at - self.block + 1], ids[at])]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            within = at < stops
            at, stops = at[within], stops[within]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence."""
        ends = self.ends(ids)
        if not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = self._key(ids[ends - self.block + 1], ids[ends])
        low = np.searchsorted(self.keys, keys, "left")
        many = np.searchsorted(self.keys, keys, "right") - low
        total = np.cumsum(many)
        starts, which, done = [], [], 0
        while done < len(ends):
            base = total[done - 1] if done else 0
            upto = max(int(np.searchsorted(total, base + COMPARED, "right")), done + 1)
            n = many[done:upto]
            end = np.repeat(ends[done:upto], n)
            row = np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:upto], n)
            for back in range(self.length):  # direct comparison, last word first
                same = ids[end - back] == self.windows[row, self.length - 1 - back]
                end, row = end[same], row[same]
            starts.append(end - self.length + 1)
            which.append(self.order[row])
            done = upto
        return np.concatenate(starts), np.concatenate(which)


class BlockSearch:
    """All windows of a block of items, by window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        number: dict[str, int] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            item = number.setdefault(name, len(number))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            rows = by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                rows.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.names = list(number)
        self.parts = [
            (WindowSearch(np.array(list(rows), np.int32)), [sorted(v) for v in rows.values()])
            for rows in by_length.values()
        ]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, list[int], set[str]]]:
        """For each text: number of words, covered words as [start, end, ...), items found."""
        pieces, bounds, at = [], [], 1
        for text in texts:
            words = words_of(text)
            pieces.append(np.fromiter(
                map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)))
            bounds.append((at, at + len(words)))
            at += len(words) + 1
        ids = np.zeros(at, np.int32)  # a zero before, between and after texts matches nothing
        for piece, (start, end) in zip(pieces, bounds, strict=True):
            ids[start:end] = piece
        steps = np.zeros(at + 1, np.int32)
        begins = np.array([start for start, _ in bounds], np.int64)
        found: dict[int, set[str]] = {}
        for search, items in self.parts:
            starts, which = search.search(ids)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + search.length, -1)
            if len(starts):
                texts_hit = np.searchsorted(begins, starts, "right") - 1
                for pair in np.unique(np.stack([texts_hit, which]), axis=1).T.tolist():
                    found.setdefault(pair[0], set()).update(self.names[i] for i in items[pair[1]])
        covered = (np.cumsum(steps) > 0).astype(np.int8)
        edges = np.flatnonzero(np.diff(covered)) + 1
        cuts = np.searchsorted(edges, begins).tolist() + [len(edges)]
        for i, (start, end) in enumerate(bounds):
            runs = (edges[cuts[i]:cuts[i + 1]] - start).tolist() if i in found else []
            yield end - start, runs, found.get(i, set())


def _merged(runs: list[int]) -> list[int]:
    """Sorted disjoint runs from any runs, flat."""
    out: list[int] = []
    for start, end in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scanner(shared: Broadcast):
    @F.arrow_udf(_FOUND)
    def scan(texts: pa.Array, runs: pa.Array, hits: pa.Array) -> pa.Array:
        rows = zip(shared.value.find(texts.to_pylist()), runs.to_pylist(), hits.to_pylist(),
                   strict=True)
        return pa.array([
            {"n_words": n, "hit_runs": _merged(before + new) if before else new,
             "hit_items": sorted({*names, *more})}
            for (n, new, names), before, more in rows
        ], _FOUND_ARROW)

    return scan


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hit_runs (covered words as flat [start, end) pairs), hit_items,
    n_hit, n_items and contaminated (at least one covered word and 5 % of all words)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"),
        F.col(item_text).alias("body"),
    )
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    docs = without(docs, "found", *ADDED)
    found = docs.withColumn("found", F.struct(
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_runs"),
        F.array().cast("array<string>").alias("hit_items")))
    for number in range(max(blocks, 1)):
        rows = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(max(blocks, 1))) == number)
        shared = spark.sparkContext.broadcast(
            BlockSearch([tuple(r) for r in rows.collect()], window))  # at most about block_bytes

        found = found.withColumn("found", _scanner(shared)(text, "found.hit_runs", "found.hit_items"))
    found = found.select(*docs.columns, "found.n_words", "found.hit_runs", "found.hit_items")
    n_hit = F.aggregate(
        F.sequence(F.lit(1), F.size("hit_runs")), F.lit(0).cast("long"),
        lambda total, i: total + F.when(i % 2 == 0, 1).otherwise(-1) * F.element_at("hit_runs", i))
    return found.withColumns({
        "n_hit": F.when(F.size("hit_runs") > 0, n_hit).otherwise(F.lit(0).cast("long")),
        "n_items": F.size("hit_items").cast("long"),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` less the contaminated ones, in their own columns."""
    rows = boxed(docs, options.get("text", "text"))
    return unboxed(find_benchmark(rows, benchmark, **options).where(~F.col("contaminated")))
