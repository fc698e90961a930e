import hashlib
import math
from collections import Counter

from vigilbus.llm.mixing import poisson_mix, repetition_rates
from vigilbus.llm.sharding import MULTIPLIER, assign_shards, shard_slots

ROWS = [(i, f"text {i}") for i in range(300)] + [(None, None), (None, "x"), (7, "text 7"), (7, ""),
                                                 (7, None)]


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def key_of(doc) -> int:
    return int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:16], 16)


def test_jump_hash_equals_the_plain_loop(frame):
    for shards in (1, 2, 8, 100):
        for r in assign_shards(frame(ROWS), shards).collect():
            assert r.shard == jump(key_of(r.doc_id), shards)
            assert r.grown_shard == jump(key_of(r.doc_id), shards + 1)
            assert r.shard == r.grown_shard or r.grown_shard == shards


def test_slots_are_gapless_and_ordered(frame):
    rows = shard_slots(frame([(1, "same")] * 400 + ROWS), 8).collect()
    assert len(rows) == 400 + len(ROWS)
    by_shard = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        by_shard.setdefault(r.shard, []).append(r)
    for held in by_shard.values():
        assert [r.slot for r in held] == list(range(len(held)))
        order = [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in held]
        assert order == sorted(order)
    assert {r["size"] for r in rows if r.doc_id is None} == {1, 2}


def test_empty_tables(frame):
    empty = frame([], "doc_id long, text string, source string")
    assert shard_slots(empty).count() == 0
    assert poisson_mix(empty, repetition_rates(empty)).count() == 0


def test_poisson_counts_equal_plain_inversion(frame):
    rows = [(i, f"t{i}" * (i % 9), "a" if i % 3 else None) for i in range(400)]
    docs = frame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS rate", "2 AS copy", "3 AS shuffle_key")
    rates = {r.source: r.rate for r in repetition_rates(docs).collect()}
    got = Counter(r.doc_id for r in poisson_mix(docs, repetition_rates(docs)).collect())
    for doc, text, source in rows:
        digest = hashlib.md5(f"mix-1|{doc}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        u = (int(hashlib.md5(f"{digest}/1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rates[source])
        c = p
        while c < u:
            k += 1
            p *= rates[source] / k
            c += p
        assert got[doc] == k


def test_weights_and_large_means(frame):
    rows = [(i, "word " * 20, "big" if i % 4 else "small") for i in range(800)]
    docs = frame(rows, "doc_id long, text string, source string")
    mixed = poisson_mix(docs, repetition_rates(docs, {"small": 1.0, "big": 1.0}))
    count = Counter(r.source for r in mixed.collect())
    assert abs(count["small"] - 400) < 80 and abs(count["big"] - 400) < 80
    one = frame([(1, "x", "s")], "doc_id long, text string, source string")
    many = poisson_mix(one, one.selectExpr("source", "2000D AS rate"))
    assert abs(many.count() - 2000) < 250
    assert {r.copy for r in many.collect()} == set(range(1, many.count() + 1))
    assert poisson_mix(docs, repetition_rates(docs, {"other": 1.0})).count() == 0
