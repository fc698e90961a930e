"""Dedup of repeated 50-byte windows by anchors and hashes, in place of a radix sort of suffixes.

No suffix is ordered by its bytes. Windows are grouped in three steps, called digits here; a group
that can't hold a repetition leaves after each, and the groups left at the end are the windows that
several documents share. The digits of a window are

1. its anchor, the 26-byte string of least hash among the 25 in the window. It depends on the
   window's bytes alone, and windows that start next to each other mostly share it, so one entry
   stands for a run of windows. Anchors of a single document leave.
2. the whole run of windows that share an anchor occurrence. Equal runs are equal windows, and all
   but those of the smallest document are repeats. A run whose anchor has no other surroundings is
   done.
3. the 50 bytes of each window that is still open: the first of equal runs, where other
   surroundings share its anchor.

Each digit is one exchange of packed hashes between slices of documents and buckets. Entries are
combined within a slice first, so a string that very many documents hold costs one entry a slice.
Bytes of windows that also start in a document of smaller id are removed.

Defined cases: a null text is empty; texts under 50 bytes keep everything; equal ids are not
smaller than each other; a null id is larger than any other; rows equal in id and text keep the
same bytes; an empty table gives an empty result; only the id and text columns are read. Windows are
compared by 56 bits of hash or more, one more for each doubling of the input, runs by 88.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.llm import packed
from vigilbus.llm.shingles import mix64

DEPTH = 50
ANCHOR = 26
HOME_BYTES = 2 << 20
HOME_ROWS = 50_000
BUCKET_BYTES = 4 << 20
_LOW = 32
_NO_ID = 2**63 - 1
WINDOW_BYTES = 6
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
TEXT, OWN = -2, -1  # buckets under which a home gets its text and what it kept
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_CUT_SQL = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "kept binary")


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position, put together from blocks of doubling size."""
    out, have, block, size = None, 0, _VALUE[raw], 1
    while True:
        by = np.uint64(pow(_BASE, size, 1 << 64))
        if n & size:
            if out is None:
                out, have = block, size
            else:
                m = len(raw) - have - size + 1
                out, have = out[:m] * by + block[have:have + m], have + size
        if 2 * size > n:
            return mix64(out)
        m = len(block) - size
        block, size = block[:m] * by + block[size:size + m], 2 * size


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchor_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, document) of each run of windows with one anchor."""
    n = len(raw) - DEPTH + 1
    if n < 1:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    least = _least(rolling(raw, ANCHOR), DEPTH - ANCHOR + 1)
    within = np.zeros(n + 1, bool)
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        within[start:max(end - DEPTH + 1, start)] = True
    within[n] = False
    follows = np.zeros(n + 1, bool)
    follows[1:n] = within[1:n] & within[:n - 1] & (least[1:] == least[:-1])
    first = np.flatnonzero(within & ~follows)
    last = np.flatnonzero(within[:n] & ~follows[1:])
    return least[first], first, last, np.searchsorted(ends, first, "right")


def _keys(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 more bits of an anchor."""
    return ((anchors >> np.uint64(64 - bits)) << np.uint64(_LOW)) | (
        anchors & np.uint64((1 << _LOW) - 1))


def _smallest(place: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Least id of each of n places."""
    out = np.full(n, _NO_ID, np.int64)
    np.minimum.at(out, place, ids)
    return out


def _gathered(answers: dict[int, dict], keys: np.ndarray, bits: int, low: int) -> np.ndarray:
    """Two-bit answers to sorted keys, in their order."""
    out = np.zeros(len(keys), np.uint8)
    for bucket, a, b in packed.by_bucket(keys, bits, low):
        both = np.unpackbits(answers[bucket]["answer"], count=2 * (b - a))
        out[a:b] = both[::2] * 2 + both[1::2]
    return out


def _told(answer: np.ndarray) -> np.ndarray:
    """Answers 0 to 2 as two bits each."""
    return np.packbits(np.stack([answer >> 1, answer & 1], axis=1).astype(np.uint8))


def _masked(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The bytes of runs; zero elsewhere."""
    steps = np.zeros(len(raw) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + DEPTH, -1)
    return np.where(np.cumsum(steps[:-1]) > 0, raw, 0).astype(np.uint8)


# Digit 1: anchors.
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Slices of documents, named by the number of their first row in the scan. They are the same
    in each scan of a table; ``check`` tells."""
    for batch in batches:
        ids, texts, row = batch.columns
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in packed.slices(sizes, HOME_BYTES, HOME_ROWS):
            bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b].to_pylist()]
            raw = b"".join(bodies)
            yield row[a].as_py(), {
                "ids": pc.fill_null(ids[a:b], _NO_ID).to_numpy(),
                "nulls": ids[a:b].is_null().to_numpy(zero_copy_only=False),
                "ends": np.cumsum([len(x) for x in bodies]), "raw": np.frombuffer(raw, np.uint8),
                "check": xxhash.xxh3_64_intdigest(raw)}


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for home, body in _scan(batches):
        body["text"] = packed.squeeze(body.pop("raw"))
        yield packed.own_row(home, TEXT, body)


def _send_anchors(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, body in _scan(batches):
            yield from packed.sent(_anchor_rows(home, body, bits))

    return send


def _anchor_rows(home: int, body: dict, bits: int):
    anchors, _, _, doc = anchor_runs(body["raw"], body["ends"])
    numbers = body["ids"][doc]
    key, place = np.unique(_keys(anchors, bits), return_inverse=True)
    low = _smallest(place, numbers, len(key))
    several = np.zeros(len(key), bool)
    several[place[numbers > low[place]]] = True
    for bucket, a, b in packed.by_bucket(key, bits, _LOW):
        yield bucket, home, {"key": key[a:b].astype(np.uint32), "check": body["check"],
                             "several": np.packbits(several[a:b])}


def _shared_anchors(asked: list[tuple[int, dict]]) -> packed.Rows:
    keys = [body["key"] for _, body in asked]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(place, minlength=len(every)) > 1
    several = np.concatenate([
        np.unpackbits(body["several"], count=len(k)) for k, (_, body) in zip(keys, asked, strict=True)])
    shared[place[several > 0]] = True
    asked_check = {home: body["check"] for home, body in asked}
    at = 0
    for key, (home, _) in zip(keys, asked, strict=True):
        yield home, {"answer": _told(shared[place[at:at + len(key)]].astype(np.uint8)),
                     "check": asked_check[home]}
        at += len(key)


# Digit 2: runs of windows around shared anchors.
def _entries(run: np.ndarray, key: np.ndarray, numbers: np.ndarray):
    """Sorted distinct (key, run), the place of each run among them, and their least ids."""
    order = np.lexsort((run, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (run[order][1:] != run[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[order][new], run[order][new], place, _smallest(place, numbers, int(new.sum()))


def _runs_of(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run of windows."""
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b + DEPTH]) >> 16
                        for a, b in zip(first.tolist(), last.tolist(), strict=True)),
                       np.uint64, len(first))


def _send_runs(bits: int):
    def step(home: int, bodies: dict[int, dict]):
        own = bodies.pop(TEXT)
        if any(b["check"] != own["check"] for b in bodies.values()):
            raise RuntimeError("the documents changed between two scans; write them to a table first")
        raw = packed.expand(own["text"])
        anchors, first, last, doc = anchor_runs(raw, own["ends"])
        keys = _keys(anchors, bits)
        unique, place = np.unique(keys, return_inverse=True)
        keep = _gathered(bodies, unique, bits, _LOW)[place] > 0
        keys, first, last, doc = keys[keep], first[keep], last[keep], doc[keep]
        key, run, place, low = _entries(_runs_of(raw, first, last), keys, own["ids"][doc])
        for bucket, a, b in packed.by_bucket(key, bits, _LOW):
            yield bucket, home, {"key": key[a:b].astype(np.uint32),
                                 "run": packed.cut(run[a:b], 6), "id": _short(low[a:b])}
        yield -1 - home, home, {
            "ids": own["ids"], "ends": own["ends"],
            "text": packed.squeeze(_masked(raw, first, last)),
            "first": packed.squeeze(np.diff(first, prepend=0).astype(np.uint32)),
            "more": packed.squeeze((last - first).astype(np.uint32))}

    return step


def _first_runs(asked: list[tuple[int, dict]]) -> packed.Rows:
    """1: repeats a smaller document; 2: first, and its anchor has other surroundings; 0: done."""
    key = np.concatenate([b["key"] for _, b in asked])
    run = np.concatenate([packed.uncut(b["run"], 6) for _, b in asked])
    ids = np.concatenate([_long(b["id"]) for _, b in asked])
    names, _, place, low = _entries(run, key, ids)
    starts, many = packed.runs(names)
    surroundings = np.repeat(many, many)
    answer = np.where(ids > low[place], 1, np.where(surroundings[place] > 1, 2, 0)).astype(np.uint8)
    at = 0
    for home, body in asked:
        yield home, {"answer": _told(answer[at:at + len(body["key"])])}
        at += len(body["key"])


# Digit 3: windows of open runs.
def _windows(raw: np.ndarray, first: np.ndarray, last: np.ndarray, numbers: np.ndarray):
    """(start, place among the distinct windows, distinct hashes, their least ids)."""
    size = last - first + 1
    start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    values = rolling(raw, DEPTH)[start] if len(start) else np.empty(0, np.uint64)
    unique, place = np.unique(values, return_inverse=True)
    of = np.repeat(numbers, size)
    return start, place, unique, _smallest(place, of, len(unique)), of


def _send_windows(bits: int):
    def step(home: int, bodies: dict[int, dict]):
        own = bodies.pop(OWN)
        raw = packed.expand(own["text"])
        first = np.cumsum(packed.expand(own["first"], np.uint32), dtype=np.int64)
        last = first + packed.expand(own["more"], np.uint32)
        numbers = own["ids"][np.searchsorted(own["ends"], first, "right")]
        keys = _keys(_least(rolling(raw, ANCHOR), DEPTH - ANCHOR + 1)[first], bits) if len(
            first) else np.empty(0, np.uint64)
        key, _, place, low = _entries(_runs_of(raw, first, last), keys, numbers)
        state = _gathered(bodies, key, bits, _LOW)
        repeated = (state[place] == 1) | (numbers > low[place])
        opened = ~repeated & (state[place] == 2)
        a, b = first[opened], last[opened]
        _, _, unique, least, _ = _windows(raw, a, b, numbers[opened])
        for g, x, y in packed.by_bucket(unique, bits, 64 - bits):
            yield g, home, {"window": packed.cut(unique[x:y], WINDOW_BYTES),
                            "id": _short(least[x:y])}
        yield -1 - home, home, {
            "ids": own["ids"], "ends": own["ends"], "text": packed.squeeze(_masked(raw, a, b)),
            "first": packed.squeeze(np.diff(a, prepend=0).astype(np.uint32)),
            "more": packed.squeeze((b - a).astype(np.uint32)),
            "gone": packed.squeeze(np.packbits(_masked(
                np.ones(len(raw), np.uint8), first[repeated], last[repeated])))}

    return step


def _short(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """Ids as 32-bit distances from the least one where they fit."""
    base = int(ids.min())
    return (base, (ids - base).astype(np.uint32)) if int(ids.max()) - base < 2**32 else (0, ids)


def _long(short: tuple[int, np.ndarray]) -> np.ndarray:
    return short[0] + short[1].astype(np.int64)


def _smaller_windows(asked: list[tuple[int, dict]]) -> packed.Rows:
    """Whether a window also starts in a smaller document than the home's."""
    windows = [packed.uncut(body["window"], WINDOW_BYTES) for _, body in asked]
    ids = [_long(body["id"]) for _, body in asked]
    _, place = np.unique(np.concatenate(windows), return_inverse=True)
    every = np.concatenate(ids)
    answer = every > _smallest(place, every, int(place.max()) + 1)[place]
    at = 0
    for (home, _), mine in zip(asked, ids, strict=True):
        yield home, {"answer": _told(answer[at:at + len(mine)].astype(np.uint8))}
        at += len(mine)


def _finish(bits: int, keep_bytes: bool):
    def step(home: int, bodies: dict[int, dict]) -> pa.Table:
        """What is left of each document of a home."""
        own, whole = bodies.pop(OWN), bodies.pop(TEXT)
        masked, ends = packed.expand(own["text"]), own["ends"]
        first = np.cumsum(packed.expand(own["first"], np.uint32), dtype=np.int64)
        last = first + packed.expand(own["more"], np.uint32)
        numbers = own["ids"][np.searchsorted(ends, first, "right")]
        start, place, unique, least, of = _windows(masked, first, last, numbers)
        smaller = _gathered(bodies, unique, bits, 64 - bits) > 0
        gone = start[smaller[place] | (of > least[place])]
        raw = packed.expand(whole["text"])
        covered = np.unpackbits(packed.expand(own["gone"]), count=len(raw)).astype(bool)
        covered |= _masked(np.ones(len(raw), np.uint8), gone, gone) > 0
        rows, begin = [], 0
        for doc, null, end in zip(whole["ids"].tolist(), whole["nulls"].tolist(), ends.tolist(),
                                  strict=True):
            out = covered[begin:end]
            kept = raw[begin:end][~out].tobytes()
            rows.append({
                "doc_id": None if null else doc, "n_bytes": end - begin,
                "n_removed": end - begin - len(kept),
                "n_spans": int(np.count_nonzero(np.diff(out, prepend=False) & out)),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
                "kept": kept if keep_bytes else None})
            begin = end
        return pa.Table.from_pylist(rows, _CUT)

    return step


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep_bytes: bool = True
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    ``docs`` is scanned three times and must give the same rows each time, as a table does.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(8, int(size // BUCKET_BYTES).bit_length())
    narrow = docs.select(F.col(key).cast("long"), F.col(text), F.monotonically_increasing_id())
    texts = narrow.mapInArrow(_send_texts, packed.ANSWER_SQL)
    rows = narrow.mapInArrow(_send_anchors(bits), packed.SENT_SQL)
    rows = packed.exchange(rows, _shared_anchors, _send_runs(bits), own=texts)
    rows = packed.exchange(rows, _first_runs, _send_windows(bits))
    return packed.exchange(
        rows, _smaller_windows, _finish(bits, keep_bytes), own=texts, schema=_CUT_SQL)
