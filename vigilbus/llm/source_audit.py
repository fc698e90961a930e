"""Divergence of sources within a language, with late strings.

Tasks count the terms of their texts by group and hand on what they hold. These counts are added up
under a 64-bit digest, in a task first, so the shuffle carries numbers only: group number, digest,
occurrences and documents. Strings come in twice, both times few:

1. Digests that enough documents hold get the least and the greatest string that they stand for,
   from a second scan. Where the two differ, terms collide: their digests are counted once more,
   by string, in a third scan, and split into (digest, part). Else the part is 0.
2. Terms whose value may rank among a group's first get their string for the last ordering.

A digest is in at least as many documents as any of its terms, so none is lost before the split, and
the result does not depend on the digest (``bits`` makes it short, to test collisions).

Pair values sum f(p_a, p_b) over all V kept terms of the language. With p0 the share of a term that a
group lacks, and over the terms of a group only,

    sum f(p_a, p_b) = V f(p0_a, p0_b)
        + sum over a's terms [f(p_a, p0_b) - f(p0_a, p0_b)] + the same for b
        + sum over shared terms [f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b)]

The sums over one group's terms need its counts' histogram only. The last sum joins on the term: a
term has at most as many rows as the language has sources, and what meets is added up by pair before
the shuffle. The result itself has a row for each pair of sources, by its definition.

Arithmetic is exact: shares come from whole-number division of decimals, the rest fits 64 bits (a
share is at most 10^9 + 1, so its square is below 2^63).

Defined cases: a null text, language or source counts as the empty one; a group without terms, and a
language without kept terms, has pair rows of its own; one source alone has no pair rows; repeated
rows count as often as they stand; an empty table gives an empty result; equal values rank by the
UTF-8 bytes of the item; only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilbus.plans.series import small_side
from vigilbus.session import ensure_checkpoint_dir

# A term is a run of letters, where all code points beyond ASCII count as letters: in UTF-8, of the
# bytes of A-Z, which become a-z, a-z and 0x80 to 0xFF. All other bytes become blanks.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: Bytes of a text that are cut into terms at a time, and terms that a task holds before it hands
#: their counts on; both bound memory and change no result.
PIECE_BYTES = 1 << 20
HELD_TERMS = 300_000
UNIT = 1_000_000_000
MIN_DOCS = 10
TOP = 10
#: Up to so many digests (8 bytes each) are sent to every task to filter terms before a shuffle;
#: with more, distinct terms are shuffled first. The result is the same.
SENT_DIGESTS = 1_000_000


class Audit:
    """One run: its documents, its groups and the folder of its tables."""

    def __init__(self, docs: DataFrame, lang: str, source: str, text: str, bits: int):
        self.bits = bits
        self.spark = docs.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/audit-{uuid4().hex}"
        self.docs = docs.select(*[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
            for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
        numbered = self.kept("groups", self.docs.select("lang", "source").distinct().withColumn(
            "g", F.monotonically_increasing_id()))
        first = numbered.groupBy("lang").agg(F.min("g").alias("l"))
        #: lang, source, group number g, language number l
        self.groups = small_side(self.kept("numbered", numbered.join(first, "lang")))

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written to the run's folder and read back."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _digest(self) -> Column:
        digest = F.xxhash64("term")
        return digest if self.bits >= 64 else digest.bitwiseAND((1 << self.bits) - 1)

    def occurrences(self) -> DataFrame:
        """(g, l, digest, term, c, docs): what one task found of a term before it handed it on."""
        found = self.docs.join(self.groups, ["lang", "source"]).select("g", "l", "text").mapInArrow(
            _count_terms, "g long, l long, term string, c long, docs long")
        return found.withColumn("digest", self._digest())

    def names(self) -> DataFrame:
        """(digest, term): the terms of a task, each once or a few times."""
        return self.docs.select("text").mapInArrow(_list_terms, "term string").select(
            self._digest().alias("digest"), "term")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some ten thousands at a time."""
    plain = text.translate(_TERM_BYTES)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def _strings(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = {}, 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (g, lang), (count, docs) in held.items():
            terms = list(count)
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([g] * len(terms), pa.int64()),
                "l": pa.array([lang] * len(terms), pa.int64()),
                "term": _strings(terms), "c": pa.array(count.values(), pa.int64()),
                "docs": pa.array([docs[t] for t in terms], pa.int64())})

    for batch in batches:
        for g, lang, text in zip(*(batch.column(i).to_pylist() for i in range(2)),
                                 batch.column(2).cast(pa.binary()), strict=True):
            count, docs = held.setdefault((g, lang), (Counter(), Counter()))
            before, mine = len(count), set()
            for terms in _pieces(text.as_py()):
                count.update(terms)
                mine.update(terms)
            docs.update(mine)
            size += len(count) - before
            if size > HELD_TERMS:
                yield from hand_on()
                held, size = {}, 0
    yield from hand_on()


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = set()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for terms in _pieces(text.as_py()):
                held.update(terms)
            if len(held) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([_strings(list(held))], names=["term"])
                held = set()
    yield pa.RecordBatch.from_arrays([_strings(list(held))], names=["term"])


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("g", "l", *by).agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _widespread(counts: DataFrame, min_docs: int, *by: str) -> DataFrame:
    return counts.groupBy("l", *by).agg(F.sum("docs").alias("_d")).where(
        F.col("_d") >= min_docs).drop("_d")


def _named(audit: Audit, digests: DataFrame) -> DataFrame:
    """(digest, low, high): least and greatest string of each of ``digests``."""
    names = audit.names()
    if digests.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS:
        names = names.join(F.broadcast(digests), "digest", "left_semi").distinct()
    else:
        names = names.distinct().join(digests, "digest", "left_semi")
    return names.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def kept_terms(audit: Audit, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(l, g, digest, part, c) of the kept terms; (digest, part, term) with their strings."""
    counts = audit.kept("counts", _counted(audit.occurrences(), "digest"))
    wide = _widespread(counts, min_docs, "digest")
    some = counts.join(wide, ["l", "digest"], "left_semi")
    digests = audit.kept("digests", wide.select("digest").distinct())
    names = audit.kept("names", _named(audit, digests))
    zero = F.lit(0).alias("part")
    single = names.where("low = high").select("digest", zero, F.col("low").alias("term"))
    collided = names.where("low <> high").select("digest")
    if not collided.limit(1).count():
        return audit.kept("terms", some.select("l", "g", "digest", zero, "c")), single
    clear = some.join(collided, "digest", "left_anti").select("l", "g", "digest", zero, "c")
    again = audit.occurrences().join(small_side(collided), "digest", "left_semi")
    split = audit.kept("split", _counted(again, "digest", "term"))
    parts = audit.kept("parts", split.select("digest", "term").distinct().withColumn(
        "part", F.row_number().over(Window.partitionBy("digest").orderBy("term"))))
    apart = split.join(_widespread(split, min_docs, "digest", "term"),
                       ["l", "digest", "term"], "left_semi").join(parts, ["digest", "term"])
    return (audit.kept("terms", clear.unionByName(apart.select("l", "g", "digest", "part", "c"))),
            single.unionByName(parts.select("digest", "part", "term")))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly; null without kept terms."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, below))


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def _totals(audit: Audit, terms: DataFrame) -> DataFrame:
    """Groups with V, their own and their language's number of occurrences, and p0."""
    of_group = terms.groupBy("l", "g").agg(F.sum("c").alias("n"))
    of_lang = terms.groupBy("l").agg(
        F.count_distinct("digest", "part").alias("v"), F.sum("c").alias("n_lang"))
    every = audit.groups.join(of_group, ["l", "g"], "left").join(of_lang, "l", "left").fillna(
        0, ["n", "v", "n_lang"])
    return every.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v")))


def _pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(a, b, value): summed gaps of every two groups of a language, both ways round."""
    other = groups.select("l", F.col("g").alias("b"), F.col("p0").alias("q0"))
    base = groups.join(other, "l").where("g <> b").select(
        F.col("g").alias("a"), "b",
        F.when(F.col("v") > 0, F.col("v") * gap("p0", "q0")).otherwise(0).cast("long").alias("value"))
    own = terms.groupBy("l", "g", "p", "p0").agg(F.count(F.lit(1)).alias("m")).join(
        small_side(other), "l").where("g <> b").groupBy(F.col("g").alias("a"), "b").agg(
        F.sum(F.col("m") * (gap("p", "q0") - gap("p0", "q0"))).alias("value"))
    right = terms.select("l", "digest", "part", F.col("g").alias("b"), F.col("p").alias("q"),
                         F.col("p0").alias("q0"))
    shared = terms.join(right, ["l", "digest", "part"]).where("g < b").groupBy(
        F.col("g").alias("a"), "b").agg(F.sum(
            gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")).alias("value"))
    one_way = own.unionByName(shared)
    turned = one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    return base.unionByName(one_way).unionByName(turned).groupBy("a", "b").agg(
        F.sum("value").alias("value"))


def _leading(terms: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    """(g, item, value, rank): terms that stand out most from their language, ``top`` a group."""
    lang = terms.groupBy("l", "digest", "part").agg(F.sum("c").alias("c_lang"))
    scored = terms.join(lang, ["l", "digest", "part"]).withColumn(
        "q", share(F.col("c_lang"), F.col("n_lang"), F.col("v"))).where("p > q").select(
        "g", "digest", "part", gap("p", "q").alias("value"))
    by_value = Window.partitionBy("g").orderBy(F.col("value").desc())
    near = scored.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    named = near.join(strings, ["digest", "part"])
    order = Window.partitionBy("g").orderBy(F.col("value").desc(), "term")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "g", F.col("term").alias("item"), "value", "rank")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang",
                  source: str = "source", text: str = "text", bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module text."""
    audit = Audit(docs, lang, source, text, bits)
    counted, strings = kept_terms(audit, min_docs)
    groups = audit.kept("totals", _totals(audit, counted))
    facts = small_side(groups.select("g", "n", "n_lang", "v", "p0"))
    terms = audit.kept("shares", counted.join(facts, "g").withColumn(
        "p", share(F.col("c"), F.col("n"), F.col("v"))).drop("n"))
    names = small_side(groups.select("g", "lang", "source"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(groups, terms).join(names.withColumnRenamed("g", "a"), "a").join(
        names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b").withColumn(
        "rank", F.row_number().over(order))
    leading = _leading(terms, strings, top).join(names, "g")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        leading.withColumn("part", F.lit("term")).select(*columns))
