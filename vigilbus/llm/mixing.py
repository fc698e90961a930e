"""Mixing sources to target weights by Poisson replication.

A document of a source with repetition rate r is repeated k times, k drawn from a Poisson
distribution of mean r by inverting a uniform number taken from a digest of (seed, id, text). The
copies are exploded and shuffled globally by a digest of the draw and the copy's number.

Defined cases: a null source is a source of its own, apart from the empty name; null ids and texts
hash as "~"; equal rows draw equal counts; an empty table gives an empty result; input columns
called like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.llm.columns import byte_size, free_name, hex_long, without
from vigilbus.session import cut_lineage

#: A larger mean is drawn as the sum of several draws, so that exp(-mean) never underflows.
LARGEST_MEAN = 500.0
#: Sources whose rates are broadcast; beyond this, Spark joins by shuffle.
SMALL_SOURCES = 10_000
ADDED = ("rate", "copies", "copy", "shuffle_key")


def repetition_rates(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """source, rate: mean repetitions that give each source its share of all bytes.

    ``weights`` are relative target shares (a source not named gets none); without them the share
    of a source is its own share to the power ``alpha``, normalised.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(byte_size(F.col(text))).cast("double").alias("bytes")
    )
    if weights is None:
        weight = F.pow(F.col("bytes"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    sizes = cut_lineage(sizes.withColumn("weight", weight))
    total = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    scale = (total[0] or 0.0) / total[1] if total[1] else 0.0
    return sizes.select("source", (F.col("weight") * scale / F.col("bytes")).alias("rate"))


def poisson_count(digest: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) >= u for X of the given mean, u from the digest.

    The cumulative sum reaches every 52-bit u before mean + 12 sqrt(mean) + 40.
    """

    def inverted(u: Column, rate: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            p = s["p"] * rate / k
            return F.when(
                s["c"] < u, F.struct(k.alias("k"), p.alias("p"), (s["c"] + p).alias("c"))
            ).otherwise(s)

        start = F.struct(
            F.lit(0).cast("long").alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c")
        )
        most = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("long")
        return F.aggregate(F.sequence(F.lit(1).cast("long"), most), start, step, lambda s: s["k"])

    def uniform(part: Column) -> Column:
        mixed = F.md5(F.concat(digest, F.lit("/"), part.cast("string")).cast("binary"))
        return (hex_long(mixed, 1, 13).cast("double") + 0.5) / float(2**52)

    parts = F.greatest(F.ceil(mean / LARGEST_MEAN), F.lit(1)).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), parts), F.lit(0).cast("long"),
        lambda total, i: total + inverted(uniform(i), mean / parts),
    )


def poisson_mix(
    docs: DataFrame, rates: DataFrame, seed: str = "mix-1", key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """Copies of ``docs`` with ``rate``, ``copies``, ``copy`` (from 1) and ``shuffle_key``.

    Rates are broadcast only if few. Rows are dealt to partitions by their random key and sorted by
    it, so that (partition, key) is a random order of all copies; no task sees one source.
    """
    docs = without(docs, *ADDED)
    named, drawn_by = free_name(docs, "rate_source"), free_name(docs, "draw_digest")
    rates = rates.select(F.col("source").alias(named), "rate")
    if rates.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES:
        rates = F.broadcast(rates)
    digest = F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("~")),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("~")),
    ).cast("binary"))
    drawn = (
        docs.join(rates, F.col(source).eqNullSafe(F.col(named)))
        .drop(named)
        .withColumn(drawn_by, digest)
        .withColumn("copies", poisson_count(F.col(drawn_by), F.col("rate")))
        .where("copies > 0")
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    keyed = copies.withColumn("shuffle_key", hex_long(F.md5(F.concat(
        F.col(drawn_by), F.lit("#"), F.col("copy").cast("string")).cast("binary")), 1, 15))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        keyed.select(*docs.columns, *ADDED)
        .repartition(parts, "shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )
