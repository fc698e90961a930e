"""Sharding by jump consistent hashing: no ring table, and a new shard takes rows only into itself.

The key of a row is the first 64 bits of the MD5 of its id as text. The 64-bit recurrence of the
jump hash is kept as two 32-bit halves, because SQL arithmetic does not wrap around.

Defined cases: a null id hashes as the empty text; a null text has size 1 and CRC 0; equal ids land
in the same shard and get slots of their own, in the order (id, size, CRC); an empty table gives an
empty result; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilbus.llm.columns import byte_size, hex_long
from vigilbus.session import cut_lineage

# Fixed value: the multiplier of the jump hash's linear congruential generator.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
#: Steps tried for every row; the few rows that need more go on in a second, longer run.
FIRST_STEPS = 64
_WORD = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64; every product stays under 2**63."""
    upper = F.shiftright(lo, 16) * _LOW
    low = lo.bitwiseAND(0xFFFF) * _LOW + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    of_hi = hi.bitwiseAND(0xFFFF) * _LOW + F.shiftleft(
        (F.shiftright(hi, 16) * _LOW).bitwiseAND(0xFFFF), 16
    )
    return (carry + lo * _HIGH + of_hi).bitwiseAND(_WORD), low.bitwiseAND(_WORD)


def _state(hi: Column, lo: Column, at: Column, ahead: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"), at.alias("at"), ahead.alias("ahead"))


def jump_shard(hi: Column, lo: Column, shards: int) -> Column:
    """Shard of a 64-bit key given as two unsigned 32-bit halves."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        nhi, nlo = _next_key(s["hi"], s["lo"])
        ahead = F.floor(
            (s["ahead"] + 1).cast("double")
            * (F.lit(float(2**31)) / (F.shiftright(nhi, 1) + 1).cast("double"))
        )
        return F.when(s["ahead"] < shards, _state(nhi, nlo, s["ahead"], ahead)).otherwise(s)

    def run(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    # Every step jumps ahead by one shard at least, so ``shards`` steps are always enough.
    first = min(shards, FIRST_STEPS)
    done = run(_state(hi, lo, F.lit(-1).cast("long"), F.lit(0).cast("long")), first)
    if shards > first:
        done = F.when(done["ahead"] < shards, run(done, shards - first)).otherwise(done)
    return done["at"].cast("int")


def key_halves(key: Column) -> tuple[Column, Column]:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return hex_long(digest, 1, 8), hex_long(digest, 9, 8)


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All of ``docs`` with ``shard`` and ``grown_shard`` (with one shard more); no shuffle."""
    hi, lo = key_halves(F.col(key))
    return docs.withColumns(
        {"shard": jump_shard(hi, lo, shards), "grown_shard": jump_shard(hi, lo, shards + 1)}
    )


def shard_slots(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 within a shard in the order (key, size, CRC). Shards are few and large, so
    no task holds one: narrow rows are range-partitioned over (shard, key, ...), which also splits
    repeated keys, and each partition adds the number of the shard's rows before it. That table
    has at most partitions + shards rows and is broadcast.
    """
    narrow = docs.select(
        F.col(key),
        byte_size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = cut_lineage(
        assign_shards(narrow, shards, key).withColumn("tie", F.monotonically_increasing_id())
    )
    order = ["shard", key, "size", "text_crc32", "tie"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumns({
            "part": F.shiftright(F.col("at"), 33),
            "at": F.col("at").bitwiseAND((1 << 33) - 1),
        })
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part", "shard")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
        .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select("part", "shard", (F.col("before") - F.col("first")).alias("shift"))
    )
    return ranged.join(F.broadcast(starts), ["part", "shard"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard",
    )
