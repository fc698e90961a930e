"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

import numpy as np

#: Bytes hashed at once; a longer text is hashed in pieces cut at white space.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_PLACE = [mix64(np.array([i + 1000], np.uint64))[0] | np.uint64(1) for i in range(64)]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        base = np.full(n, _BASE, np.uint64)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0][:n], _powers[1][:n]


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every maximal run of non-blank bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = np.empty(len(raw) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:len(raw)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts])


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of lower-cased bytes, piece by piece."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        s, h = _piece_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs of non-blank characters with A-Z lower-cased. A text of fewer words than
    ``width`` has one shingle, all its words; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([len(r) + 1 for r in raw])
    starts, hashes = words(b"\n".join(raw).lower())
    cuts = np.searchsorted(starts, np.concatenate([[0], bounds]))
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        rolled += hashes[j:j + len(rolled)] * _PLACE[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            found = np.sort(rolled[a:b - width + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif b > a:
            some = hashes[a:b] * np.array(_PLACE[:b - a])
            out.append(mix64(some.sum(keepdims=True) + _PLACE[10 + b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
