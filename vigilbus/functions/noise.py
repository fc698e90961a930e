"""Seeded draws as a function of row keys, so results do not depend on partitioning.

The source is a digest of "seed|key|key...", which other SQL engines can reproduce.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hex digits used: 52 bits, exact in a double


def digest(seed: int | str, *keys: Column | str) -> Column:
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Number in [0, 1)."""
    head = F.substring(digest(seed, *keys), 1, DIGITS)
    return F.conv(head, 16, 10).cast("double") / float(16**DIGITS)


def integer(below: int, seed: int | str, *keys: Column | str) -> Column:
    return F.floor(uniform(seed, *keys) * below).cast("int")


def gaussian(seed: int | str, *keys: Column | str) -> Column:
    """Standard normal draw from two uniforms."""
    radius = F.sqrt(-2.0 * F.ln(1.0 - uniform(f"{seed}a", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(f"{seed}b", *keys))


def laplace(seed: int | str, *keys: Column | str) -> Column:
    """Laplace draw with scale 1 (the one-in-2^52 draw of exactly 0 is nudged)."""
    u = uniform(seed, *keys) - 0.5
    return -F.signum(u) * F.ln(F.greatest(1.0 - 2.0 * F.abs(u), F.lit(2.0**-52)))


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(2**32 * abs(math.sin(i + 1))) for i in range(64)]


def _md5_start(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two state words of the MD5 of one-block messages, given as their 16 words by column."""
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in first)
    for i in range(64):
        turn, at = divmod(i, 16)
        if turn == 0:
            mixed, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            mixed, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            mixed, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, g = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += words[g]
        mixed += np.uint32(_SINES[i])
        left = _TURNS[turn][at % 4]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(left)) | (mixed >> np.uint32(32 - left)))
    return a + first[0], b + first[1]


def uniforms(prefix: str, start: int, stop: int) -> np.ndarray:
    """``uniform`` for the keys ``prefix|start`` to ``prefix|(stop - 1)``, as numbers of a task."""
    out = np.empty(stop - start)
    head = np.frombuffer(f"{prefix}|".encode(), np.uint8)
    low = start
    while low < stop:  # numbers with equally many digits
        digits = len(str(low))
        high = min(stop, 10**digits)
        n, size = high - low, len(head) + digits
        if size > 55:
            raise ValueError("a draw's key must fit one block")
        text = np.zeros((64, n), np.uint8)
        text[:len(head)] = head[:, None]
        rest = np.arange(low, high)
        for place in reversed(range(len(head), size)):
            rest, text[place] = np.divmod(rest, 10)
        text[len(head):size] += ord("0")
        text[size] = 0x80
        text[56], text[57] = 8 * size & 255, 8 * size >> 8
        words = sum(text[i::4].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
        a, b = _md5_start(words)
        # The digest is little-endian; its first 13 hex digits are four bytes and 20 bits.
        number = (a.byteswap().astype(np.uint64) << np.uint64(20)) | (
            b.byteswap() >> np.uint32(12)).astype(np.uint64)
        out[low - start:high - start] = number.astype(float) / float(16**DIGITS)
        low = high
    return out
