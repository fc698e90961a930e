"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is positive. The code is cut into
four segments of 16 bits, each indexed on its own. A query probes, in every segment, first the
bucket of its own value, then those one bit away, and so on. After radius r all codes within
4 (r + 1) - 1 bits have been met, so a query stops once its kth verified distance is below
4 (r + 1); the others go on with the next radius.

Index and probes meet by segment and leading bits. There, numpy finds the buckets at the radius and
verifies distances; only the k nearest codes of a query leave a group, never the candidates. Equal
codes are one entry, and keep their k smallest ids.

Defined cases: a null vector has no code and takes no part; a null or NaN value is a zero bit;
dimensions beyond 64 are refused, fewer leave the upper bits zero; null ids are not found and don't
ask; equal distances go to smaller ids; repeated ids are rows of their own; with fewer than k rows
all are returned.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilbus.session import cut_lineage

SEGMENTS, SEGMENT_BITS = 4, 16
#: Codes of one segment that a group should hold.
GROUP_ROWS = 1 << 20
_FOUND = pa.schema([("query", pa.int64()), ("code", pa.int64()), ("distance", pa.int64())])


def sign_code(vector: Column) -> Column:
    """64-bit code: bit i is set where value i is positive."""
    checked = F.when(F.size(vector) > 64, F.raise_error(F.lit("more than 64 dimensions"))).otherwise(
        vector)
    bit = F.transform(checked, lambda x, i: F.when(
        (x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i))
        .otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segment(code: Column, number: Column) -> Column:
    return F.call_function(
        "shiftright", code, (number * SEGMENT_BITS).cast("int")).bitwiseAND(0xFFFF)


def _split(codes: DataFrame, prefix_bits: int) -> DataFrame:
    """``codes`` with segment and prefix of the segment's value."""
    return codes.withColumn("segment", F.explode(F.array(*map(F.lit, range(SEGMENTS))))).select(
        *codes.columns, "segment",
        F.shiftright(_segment(F.col("code"), F.col("segment")), SEGMENT_BITS - prefix_bits)
        .cast("int").alias("prefix"))


def _values(codes: np.ndarray, segment: int) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(segment * SEGMENT_BITS)) & np.uint64(0xFFFF)


def _probe(radius: int, k: int):
    def probe(key: tuple, index: pa.Table, asking: pa.Table) -> pa.Table:
        """For each query, the k nearest codes among buckets at the radius in this segment."""
        segment = key[0].as_py()
        codes, first = index.column("code").to_numpy(), index.column("first").to_numpy()
        queries = asking.column("code").to_numpy()
        if not len(codes) or not len(queries):
            return _FOUND.empty_table()
        order = np.argsort(_values(codes, segment), kind="stable")
        codes, first = codes[order], first[order]
        buckets, starts, many = np.unique(
            _values(codes, segment), return_index=True, return_counts=True)
        out = []
        for query in queries:
            own = _values(np.array([query]), segment)
            hit = np.flatnonzero(np.bitwise_count(buckets ^ own) == radius)
            if not len(hit):
                continue
            size = many[hit]
            at = np.repeat(starts[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            met = codes[at]
            distance = np.bitwise_count((met ^ query).view(np.uint64)).astype(np.int64)
            best = np.lexsort((first[at], distance))[:k]
            out.append(pa.table(
                [np.full(len(best), query), met[best], distance[best]], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return probe


def _nearest(found: DataFrame, order: list[str], k: int, by: str) -> DataFrame:
    """The k first rows of each query; Spark cuts to k before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest rows of each row of ``queries``."""
    coded = cut_lineage(vectors.select(
        F.col(key).alias("id"), sign_code(F.col(vector)).alias("code")).where(
            "id IS NOT NULL AND code IS NOT NULL"))
    asked = cut_lineage(queries.select(
        F.col(key).alias("query_id"), sign_code(F.col(vector)).alias("query")).where(
            "query_id IS NOT NULL AND query IS NOT NULL"))
    # A code's k smallest ids, and their smallest as the code's own place among ties.
    ids = cut_lineage(_nearest(coded, ["id"], k, "code").select("code", "id"))
    first = ids.groupBy("code").agg(F.min("id").alias("first"))
    codes = cut_lineage(first)
    prefix_bits = min(SEGMENT_BITS, max(3, (codes.count() // GROUP_ROWS).bit_length()))
    index = cut_lineage(_split(codes, prefix_bits))
    prefixes = F.array(*map(F.lit, range(1 << prefix_bits)))
    active = cut_lineage(asked.select(F.col("query").alias("code")).distinct())
    nearest, results = None, []
    for radius in range(SEGMENT_BITS + 1):
        probes = (
            _split(active, prefix_bits)
            .withColumn("to", F.explode(prefixes))
            .where(F.bit_count(F.col("prefix").bitwiseXOR(F.col("to"))) <= radius)
            .select("code", "segment", F.col("to").alias("prefix")))
        found = index.groupBy("segment", "prefix").cogroup(
            probes.groupBy("segment", "prefix")).applyInArrow(
                _probe(radius, k), "query long, code long, distance long")
        if nearest is not None:
            found = found.union(nearest.select("query", "code", "distance"))
        # Ties at the kth distance are settled by the smallest id that a code has.
        ranked = found.distinct().join(codes, "code")
        nearest = cut_lineage(_nearest(ranked, ["distance", "first"], k, "query"))
        worst = nearest.groupBy("query").agg(
            F.max("distance").alias("worst"), F.count(F.lit(1)).alias("have"))
        covered = worst.where(
            (F.col("have") >= k) & (F.col("worst") < SEGMENTS * (radius + 1))
        ).select("query") if radius < SEGMENT_BITS else worst.select("query")
        done = cut_lineage(nearest.join(covered, "query", "left_semi"))
        results.append(done.select("query", "code", "distance"))
        nearest = nearest.join(covered, "query", "left_anti")
        active = cut_lineage(active.join(
            covered, active["code"] == covered["query"], "left_anti"))
        if active.isEmpty():
            break
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    rows = every.join(ids, "code").join(asked, "query")
    return _nearest(rows, ["distance", "id"], k, "query_id").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbour_id"),
        F.col("distance").cast("int").alias("distance"))
