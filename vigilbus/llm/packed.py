"""Exchanges of packed arrays: slices of a table ("homes") ask buckets of hashes, which answer.

A row is (g, home, body): bucket rows have g >= 0, a home's own row g = -1 - home and passes the
buckets unread. Bodies are dictionaries of numpy arrays.
"""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SENT_SQL = "g long, home long, body binary"
ANSWER_SQL = "home long, bucket long, body binary"
_SENT = pa.schema([("g", pa.int64()), ("home", pa.int64()), ("body", pa.binary())])
_ANSWER = pa.schema([("home", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary())])
Rows = Iterator[tuple[int, dict]]


def slices(sizes: list[int], most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) of at most so many bytes and rows, or one larger row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most_bytes or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def home_number(ordinal: int) -> int:
    """Number of a task's slice; a task that runs again makes the same slices."""
    return (TaskContext.get().partitionId() << 24) + ordinal


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    if not len(ordered):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(ordered)]]))


def by_bucket(keys: np.ndarray, bits: int, low: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of sorted keys whose bits above ``low`` name the bucket."""
    cuts = np.searchsorted(
        keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(low)).tolist()
    for bucket, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if b > a:
            yield bucket, a, b


def dump(body: dict) -> bytes:
    return pickle.dumps(body, protocol=5)


def squeeze(array: np.ndarray) -> tuple[bytes, int]:
    data = array.tobytes()
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True), len(data)


def expand(packed: tuple[bytes, int], kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[0], packed[1], codec="zstd", asbytes=True), kind)


def cut(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def uncut(body: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def sent(rows: Iterator[tuple[int, int, dict]]) -> Iterator[pa.RecordBatch]:
    for g, home, body in rows:
        yield pa.RecordBatch.from_pylist([{"g": g, "home": home, "body": dump(body)}], _SENT)


def own_row(home: int, kind: int, body: dict) -> pa.RecordBatch:
    """A row that goes to its home directly, as the answer of ``kind``, a negative bucket."""
    return pa.RecordBatch.from_pylist([{"home": home, "bucket": kind, "body": dump(body)}], _ANSWER)


def _in_bucket(answer: Callable[[list[tuple[int, dict]]], Rows]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if g < 0:
            bucket = pa.array([-1] * len(table), pa.int64())
            return table.drop_columns(["g"]).add_column(1, "bucket", bucket).cast(_ANSWER)
        asked = sorted(zip(table.column("home").to_pylist(), table.column("body").to_pylist(),
                           strict=True))
        out = answer([(home, pickle.loads(body)) for home, body in asked])
        return pa.Table.from_pylist(
            [{"home": h, "bucket": g, "body": dump(b)} for h, b in out], _ANSWER)

    return run


def _at_home(step: Callable, whole: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        home = key[0].as_py()
        bodies = {b: pickle.loads(x) for b, x in zip(
            table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True)}
        if whole:
            return step(home, bodies)
        return pa.Table.from_pylist(
            [{"g": g, "home": h, "body": dump(b)} for g, h, b in step(home, bodies)], _SENT)

    return run


def exchange(
    rows: DataFrame, answer: Callable, step: Callable, own: DataFrame | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Buckets answer what homes asked; homes go on with the answers and their own rows.

    ``step`` gets a home and its bodies by bucket (own rows under negative numbers) and yields
    rows for the next exchange or, with a ``schema``, returns a table of it.
    """
    answers = rows.groupBy("g").applyInArrow(_in_bucket(answer), ANSWER_SQL)
    if own is not None:
        answers = answers.union(own)
    return answers.groupBy("home").applyInArrow(
        _at_home(step, schema is not None), schema or SENT_SQL)
