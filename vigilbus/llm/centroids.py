"""Centroid clustering of whole-number vectors by equal-average equal-variance search.

Every vector and centroid carries its sum S and T = floor(sqrt(d * (sum of squares) - S * S)), the
whole part of d times its deviation. For a vector x and a centroid c of d components

    d * distance(x, c) >= (S_x - S_c)**2 + max(0, |T_x - T_c| - 1)**2

by the inequalities of mean and deviation; the 1 makes up for the two whole parts, so the bound holds
in whole numbers. Centroids are sorted by sum. A vector's search starts between the two centroids
around its own sum and goes outward, the nearer side first. It ends when the mean alone rules the
next centroid out, passes over those that the deviation rules out, and measures the rest exactly.
Bounds must exceed the best distance strictly, so ties go to the smaller centroid number.

Each round is one map over the vectors: tasks hold the k centroids and emit at most k rows of sums,
which Spark adds up; k * d sums reach the driver, which divides them exactly. Hot clusters are thus
never gathered. Vectors are made whole numbers once and kept as a Parquet table in the checkpoint
folder, so that each round reads it again and no lineage grows.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite one take no part and get no row; a null id counts as the empty text for the choice of
the first centroids and passes through; repeated ids are vectors of their own, their ties broken by
components; fewer vectors than centroids make as many centroids as vectors; an empty table gives an
empty result; only the two named columns are read, so other columns cannot clash. Components are
refused, with an error, beyond the size at which 64-bit sums of squares are exact (16,384 for 64
components scaled by 1024).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.session import ensure_checkpoint_dir

#: Vectors handled together in a task; bounds its arrays to so many times the components.
CHUNK = 8192


def largest_component(dims: int) -> int:
    """Bound below which d times a squared distance fits 63 bits."""
    return int((2**63 - 1) ** 0.5) // (2 * dims) - 1


def whole_vectors(vectors: DataFrame, dims: int, scale: int = 1024, key: str = "vec_id",
                  vector: str = "embedding") -> DataFrame:
    """(id, v array<long>): floor(scale * x) of every component of the vectors that take part."""
    kind = dict(vectors.dtypes)[key]
    values = F.col(vector).cast("array<double>")
    good = (F.size(vector) == dims) & F.forall(values, lambda x: F.coalesce(
        F.abs(x) < float("inf"), F.lit(False)))
    limit = largest_component(dims)

    def whole(x: Column) -> Column:
        return F.when(F.abs(x) * scale < limit, F.floor(x * scale).cast("long")).otherwise(
            F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))

    return vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(key).cast(kind).alias("id"), F.transform(values, whole).alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests; k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def root(squares: np.ndarray) -> np.ndarray:
    """Whole part of the square root of 64-bit whole numbers."""
    guess = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    guess -= guess * guess > squares
    return guess + ((guess + 1) * (guess + 1) <= squares)


def _spread(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return root(rows.shape[1] * np.einsum("ij,ij->i", rows, rows) - sums * sums)


@dataclass(frozen=True)
class Centroids:
    """Centroids in the order of their sums."""

    rows: np.ndarray
    number: np.ndarray
    sums: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Centroids:
        sums = centroids.sum(axis=1)
        order = np.lexsort((np.arange(len(sums)), sums))
        rows = centroids[order]
        return cls(rows, order, sums[order], _spread(rows, sums[order]))


def nearest(x: np.ndarray, to: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(centroid number, squared distance) of every row of ``x``, by scanning outward."""
    dims, k = x.shape[1], len(to.sums)
    sums = x.sum(axis=1)
    spread = _spread(x, sums)
    right = np.searchsorted(to.sums, sums)
    left = right - 1
    best = np.full(len(x), -1, np.int64)
    number = np.full(len(x), k, np.int64)
    active = np.arange(len(x))
    far = np.iinfo(np.int64).max
    for _ in range(k):
        lo, hi, s = left[active], right[active], sums[active]
        below = np.where(lo >= 0, s - to.sums[np.maximum(lo, 0)], far)
        above = np.where(hi < k, to.sums[np.minimum(hi, k - 1)] - s, far)
        go_left = below <= above
        gap = np.where(go_left, below, above)
        # Both sides are at least this far off in the mean, so the search of a vector ends here.
        known = best[active] >= 0
        going = (gap != far) & ~(known & (np.where(gap == far, 0, gap) ** 2 > dims * best[active]))
        active, go_left, gap, known = active[going], go_left[going], gap[going], known[going]
        if not len(active):
            break
        at = np.where(go_left, left[active], right[active])
        left[active] -= go_left
        right[active] += ~go_left
        apart = np.maximum(np.abs(spread[active] - to.spread[at]) - 1, 0)
        measured = ~(known & (gap**2 + apart**2 > dims * best[active]))
        who, at = active[measured], at[measured]
        diff = x[who] - to.rows[at]
        distance = np.einsum("ij,ij->i", diff, diff)
        better = (best[who] < 0) | (distance < best[who]) | (
            (distance == best[who]) & (to.number[at] < number[who]))
        best[who[better]], number[who[better]] = distance[better], to.number[at[better]]
    return number, best


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(start, CHUNK)
            flat = piece.column("v").flatten().to_numpy(zero_copy_only=False)
            yield piece, flat.reshape(-1, dims)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, total array<long>): vectors and component sums of each non-empty cluster."""
    spark = whole.sparkSession
    shared = spark.sparkContext.broadcast(centroids)
    schema = "cluster int, n long, total array<long>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = shared.value.shape
        to = Centroids.of(shared.value)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _chunks(batches, dims):
            number, _ = nearest(x, to)
            for c in np.unique(number):
                mine = x[number == c]
                n[c] += len(mine)
                total[c] += mine.sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(used.astype(np.int32)), "n": pa.array(n[used]),
            "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    partial = whole.select("v").mapInArrow(add, schema)
    return partial.select("cluster", "n", F.posexplode("total").alias("place", "part")).groupBy(
        "cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))


def move(centroids: np.ndarray, whole: DataFrame) -> np.ndarray:
    """Centroids after one round; empty ones stay."""
    moved = centroids.copy()
    for row in cluster_sums(whole, centroids).collect():
        moved[row["cluster"], row["place"]] = row["total"] // row["n"]
    return moved


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    shared = whole.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(whole.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = shared.value.shape[1]
        to = Centroids.of(shared.value)
        for piece, x in _chunks(batches, dims):
            number, distance = nearest(x, to)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=["id", "cluster", "distance"])

    return whole.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024,
            seed: int = 3, key: str = "vec_id", vector: str = "embedding",
            ) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance per vector; final centroids, one row each)."""
    spark = vectors.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/centroids-{uuid4().hex}"
    whole_vectors(vectors, dims, scale, key, vector).write.parquet(f"{folder}/vectors")
    whole = spark.read.parquet(f"{folder}/vectors")
    centroids = first_centroids(whole, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = move(centroids, whole)
    if not len(centroids):
        none = whole.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumnRenamed("id", key), centroids
    assign(whole, centroids).write.parquet(f"{folder}/assigned")
    return spark.read.parquet(f"{folder}/assigned").withColumnRenamed("id", key), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the summed distance of each row's cluster and of all rows.

    The join's other side has one row a cluster; the sums are exact beyond 64 bits until the end.
    """
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(wide.alias("part"))
    whole = sums.agg(F.sum("part")).first()[0] or 0
    small = F.broadcast(sums.select("cluster", F.col("part").cast("long").alias("cluster_inertia")))
    return assigned.join(small, "cluster").withColumn("inertia", F.lit(int(whole)).cast("long"))
