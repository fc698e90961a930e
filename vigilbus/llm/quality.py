"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and those of the lines before and after
it; the chain's transitions are learnt with them by gradient ascent on the likelihood of line
labels, where every line of a labelled document carries the document's label. A document's score
is the mean of its lines' forward-backward marginals of "good", weighted by line length.

The fit uses a bounded sample of labelled documents in the order of a hash of the id: at most
``TRAIN_DOCS``, and none after ``TRAIN_LINES`` lines. Each is taken with all its lines, whose
features are made in tasks; scoring reads every line of every text.

Defined cases: a null or empty text is one empty line; ids that hash to fold 1 are held out, and a
null id hashes as the empty text; null labels teach nothing; without labels of both kinds every
score is the share of label 1 (0.5 without labels); labels of repeated ids all count; input columns
called like an added one are replaced.
"""

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vigilbus.llm.columns import without
from vigilbus.session import cut_lineage

TRAIN_DOCS = 6000
#: Lines of all chosen documents together; the last one may exceed it, as none is cut.
TRAIN_LINES = 500_000
FOLDS, HELD_OUT = 3, 1
ADDED = ("held_out", "score", "predicted")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_ODD = b"%$&*#|!~^<>{}=\\_@+/[]`"
_PUNCT = b".,;:?'\"()-"
_ENDS = (b".", b"!", b"?", b'"', b":")
OWN = 15  # features of one line
WIDTH = 3 * OWN + 3


def _line(line: bytes, seen: set[bytes]) -> list[float]:
    n = len(line)
    words = line.split()
    if not words:
        return [0.0] * (OWN - 1) + [1.0]
    upper = n - len(line.translate(None, _UPPER))
    letters = n - len(line.translate(None, _LOWER)) + upper
    digits = n - len(line.translate(None, _DIGITS))
    odd = n - len(line.translate(None, _ODD))
    punct = n - len(line.translate(None, _PUNCT))
    repeated = line in seen
    seen.add(line)
    return [
        upper / (letters + 1), digits / n, min(5 * odd / n, 1.0), min(5 * punct / n, 1.0),
        math.log1p(len(words)) / 5, float(len(words) <= 3), len(set(words)) / len(words),
        float(words[-1].endswith(_ENDS)), float(repeated), min(len(line) / len(words), 20) / 20,
        float(line[:1].islower()), letters / n, min(10 * line.count(b" | ") / len(words), 1.0),
        sum(map(eq, words, words[1:])) / len(words), 0.0,
    ]


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, line lengths in bytes plus one) of a text."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    seen: set[bytes] = set()
    return (np.array([_line(x, seen) for x in lines], np.float64),
            np.array([len(x) + 1 for x in lines], np.float64))


def in_context(own: np.ndarray) -> np.ndarray:
    """lines x WIDTH features: a line's own, those of its neighbours, and its place."""
    edge = np.zeros((1, OWN))
    n = len(own)
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    first, last = np.zeros((n, 1)), np.zeros((n, 1))
    first[0], last[-1] = 1, 1
    return np.hstack([own, before, after, np.ones((n, 1)), first, last])


class Packed:
    """Sequences laid out by time step, longest first, so that a step's active ones are a prefix."""

    def __init__(self, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        longest = int(sizes.max())
        # At step t the sequences longer than t are active.
        self.active = np.searchsorted(-sizes[order], -np.arange(longest), "left")
        self.rows = [starts[order[:n]] + t for t, n in enumerate(self.active)]


def forward_backward(unary: np.ndarray, links: np.ndarray, packed: Packed):
    """Marginals of state 1, expected transitions (2 x 2) and the summed log partition.

    ``unary`` is the log-odds of state 1 of each line, ``links`` the 2 x 2 log transition weights.
    Forward and backward values are normalised at every step.
    """
    weight = np.exp(links)
    local = np.exp(np.stack([np.minimum(-unary, 0.0), np.minimum(unary, 0.0)], axis=1))
    forward = np.empty_like(local)
    log_z = float(np.maximum(unary, 0.0).sum())
    last = None
    for rows in packed.rows:
        now = local[rows] if last is None else (last[:len(rows)] @ weight) * local[rows]
        total = now.sum(axis=1, keepdims=True)
        log_z += float(np.log(total).sum())
        last = forward[rows] = now / total
    marginal = np.empty(len(unary))
    expected = np.zeros((2, 2))
    after = None
    for t in range(len(packed.rows) - 1, -1, -1):
        rows = packed.rows[t]
        back = np.ones((len(rows), 2))
        if after is not None:
            going = local[packed.rows[t + 1]] * after
            m = len(going)
            joint = forward[rows[:m], :, None] * weight * going[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:m] = going @ weight.T
            back /= back.sum(axis=1, keepdims=True)
        both = forward[rows] * back
        marginal[rows] = both[:, 1] / both.sum(axis=1)
        after = back
    return marginal, expected, log_z


def fit(owns: list[np.ndarray], labels: list[int], rounds: int = 150, decay: float = 1e-3) -> dict:
    """Weights of the chain from documents' own features and labels (0 or 1), by Adam."""
    share = float(np.mean(labels)) if labels else 0.5
    model = {"w": np.zeros(WIDTH), "links": np.zeros((2, 2)), "share": share, "fitted": False}
    if len(set(labels)) < 2:
        return model
    made = [in_context(own) for own in owns]
    sizes = np.array([len(m) for m in made])
    x, y = np.vstack(made), np.repeat(np.array(labels, float), sizes)
    packed = Packed(sizes)
    pairs = np.zeros((2, 2))
    for label, size in zip(labels, sizes, strict=True):
        pairs[label, label] += size - 1
    n = len(y)
    value = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, rounds + 1):
        links = value[WIDTH:].reshape(2, 2)
        marginal, expected, _ = forward_backward(
            np.clip(x @ value[:WIDTH], -30, 30), links, packed)
        slope = np.concatenate([x.T @ (y - marginal), (pairs - expected).ravel()]) / n
        slope -= decay * value
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        value += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return model | {"w": value[:WIDTH], "links": value[WIDTH:].reshape(2, 2), "fitted": True}


def score_texts(texts: list[str | None], model: dict) -> list[float]:
    """Length-weighted mean marginal of "good" of each text."""
    if not texts:
        return []
    if not model["fitted"]:
        return [model["share"]] * len(texts)
    unary, weights, sizes = [], [], []
    for text in texts:
        own, length = own_features(text)
        unary.append(in_context(own) @ model["w"])
        weights.append(length)
        sizes.append(len(length))
    sizes = np.array(sizes)
    marginal, _, _ = forward_backward(
        np.clip(np.concatenate(unary), -30, 30), model["links"], Packed(sizes))
    lengths = np.concatenate(weights)
    starts = np.cumsum(sizes) - sizes
    mean = np.add.reduceat(marginal * lengths, starts) / np.add.reduceat(lengths, starts)
    return np.clip(mean, 0.0, 1.0).tolist()


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


@F.arrow_udf(BinaryType())
def _own_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([own_features(t)[0].tobytes() for t in texts.to_pylist()], pa.binary())


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", most: int = TRAIN_DOCS,
) -> dict:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only numbers are collected."""
    chosen = (
        labels.where((fold(key) != HELD_OUT) & F.col(label).isin(0, 1))
        .select(F.col(key), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(key), key, "label").limit(most)
    )
    made = cut_lineage(
        docs.select(key, text).join(F.broadcast(chosen), key)  # at most ``most`` rows
        .select(key, "label", F.md5(text).alias("digest"), _own_bytes(F.col(text)).alias("own"),
                F.monotonically_increasing_id().alias("row")))
    sizes = made.select(
        key, "label", "digest", "row", (F.length("own") / (8 * OWN)).cast("long").alias("lines"),
    ).orderBy(F.xxhash64(key), key, "label", "digest").limit(most).select("row", "lines").collect()
    place, lines = {}, 0
    for row, n in sizes:
        if lines >= TRAIN_LINES:
            break
        place[row] = len(place)
        lines += n
    rows = made.where(F.col("row").isin(list(place))).select("row", "label", "own").collect()
    rows.sort(key=lambda r: place[r[0]])
    return fit([np.frombuffer(r[2]).reshape(-1, OWN) for r in rows], [r[1] for r in rows])


def _scorer(shared: Broadcast):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts.to_pylist(), shared.value), pa.float64())

    return score


def score_quality(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted (1: good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    docs = without(docs, *ADDED)
    return docs.withColumns({
        "held_out": fold(key) == HELD_OUT, "score": _scorer(shared)(F.col(text)),
    }).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
