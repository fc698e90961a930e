"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language l:

    P(l | row) ~ P(text | l) P(declared markup | l) P(address suffix | l) P(l | host)

P(text | l) is a model of hashed byte trigrams, counted over all labelled documents. The other
terms come from grouped sums of the text-only posteriors over all rows: how often a markup language
or an address suffix goes with l, and a host's prior, smoothed towards its domain, the domain
towards its suffix, the suffix towards all rows. A row's own posterior is taken out of its host's
sums, so that it isn't counted twice.

Defined cases: a null or empty text leaves the decision to the other evidence; a missing address or
markup is no evidence; a null language teaches nothing; without any labelled document the result
has no language and an empty distribution; equal scores go to the language first in the alphabet;
rows are judged one by one, so null and repeated ids pass through; only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.session import cut_lineage

BUCKETS = 1 << 14
#: Languages of the model, which is broadcast: at most so many rows of ``BUCKETS`` numbers.
MOST_LANGUAGES = 300
SMOOTH = 0.5
#: Text likelihoods count at most so many trigrams; more of the same text are not independent.
EFFECTIVE = 60.0
#: Pseudo-counts of a level's prior at the level below it.
STRENGTH = 5.0
_PIECE = 1 << 20
_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of lower-cased text, piece by piece."""
    data = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(18)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of each batch, combined before they are shuffled."""
    for batch in batches:
        totals: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw), _PIECE):
                held += np.bincount(_trigrams(raw[at:at + _PIECE + 2]), minlength=BUCKETS)
        for lang, held in totals.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some.astype(np.int32)),
                 pa.array(held[some])], schema=_COUNTS)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Log probabilities of trigrams by language, over all labelled documents."""
    counts = cut_lineage(
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).cast("string"), F.col(text))
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    place = {name: i for i, name in enumerate(langs)}
    for name, bucket, n in counts.collect():  # at most languages x buckets
        table[bucket, place[name]] += n
    return {"langs": langs, "log": np.log(table / table.sum(axis=0)).astype(np.float32)}


def _scorer(shared: Broadcast):
    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        out = []
        for text in texts.to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            total, n = np.zeros(len(model["langs"])), 0
            for at in range(0, len(raw), _PIECE):
                grams = _trigrams(raw[at:at + _PIECE + 2])
                seen = np.bincount(grams, minlength=BUCKETS)
                some = np.flatnonzero(seen)
                total += seen[some] @ model["log"][some]
                n += len(grams)
            scaled = total * (min(n, EFFECTIVE) / n) if n else total
            scaled = np.exp(scaled - scaled.max()) if len(scaled) else scaled
            out.append((scaled / scaled.sum()).tolist() if len(scaled) else [])
        return pa.array(out, pa.list_(pa.float64()))

    return score


# Addresses and markup, as column expressions.
def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def markup_of(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def visible_text(html: Column) -> Column:
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(plain, "<[^>]*+>", " "), r"&[A-Za-z#0-9]{1,8};", " ")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text, host, domain, suffix and markup; the suffix is the last label of the
    host and, where the path starts with one, its language folder."""
    host = host_of(F.col(url))
    labels = F.split(host, r"\.")
    folder = F.lower(F.regexp_extract(F.col(url), r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return pages.select(
        "*", visible_text(F.col(html)).alias("evidence_text"), host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
        .alias("domain"),
        F.concat_ws("/", F.element_at(labels, -1), F.nullif(folder, F.lit(""))).alias("suffix"),
        markup_of(F.col(html)).alias("markup"))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors by keys, as one array; rows of null keys are left out."""
    known = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)) if keys else rows
    return known.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(name))


def _share(counts: Column, prior: Column) -> Column:
    """Counts smoothed by a prior, normalised."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + STRENGTH
    return F.zip_with(counts, prior, lambda c, p: (c + STRENGTH * p) / total)


def identify(rows: DataFrame, model: dict, key: list[str]) -> DataFrame:
    """key columns, lang, probability and text_lang of rows with evidence_text, host, domain, suffix
    and markup (any of them may be null)."""
    langs, n = model["langs"], len(model["langs"])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES
    if not langs:
        return rows.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast(
            "double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    scored = cut_lineage(rows.select(
        *key, "host", "domain", "suffix", "markup", _scorer(shared)("evidence_text").alias("post")))
    zero = F.array(*[F.lit(0.0)] * n)
    flat = F.array(*[F.lit(1.0 / n)] * n)
    everything = cut_lineage(_sums(scored, [], n, "all_sums")).first()[0] or [0.0] * n
    overall = F.array(*[F.lit((x or 0.0) + 1.0) for x in everything])
    total = sum((x or 0.0) + 1.0 for x in everything)
    top = F.transform(overall, lambda x: x / total)
    joined = scored
    # Tables of hosts, domains, suffixes and markup are joined as Spark sees fit; it splits a host
    # that holds very many rows.
    for keys, name in ((["host"], "by_host"), (["domain"], "by_domain"), (["suffix"], "by_suffix"),
                       (["markup"], "by_markup")):
        joined = joined.join(_sums(scored, keys, n, name), keys, "left")

    def without_own(counts: str) -> Column:
        return F.zip_with(F.coalesce(F.col(counts), zero), "post", lambda c, p: F.greatest(
            c - p, F.lit(0.0)))

    def ratio(counts: str) -> Column:
        """P(value | l) up to a factor: P(l | value) / P(l)."""
        share = _share(without_own(counts), top)
        return F.when(F.col(counts).isNull(), F.transform(flat, lambda _: F.lit(1.0))).otherwise(
            F.zip_with(share, top, lambda a, b: a / b))

    prior = F.when(F.col("by_host").isNull(), top).otherwise(
        _share(without_own("by_host"), F.when(F.col("by_domain").isNull(), top).otherwise(
            _share(without_own("by_domain"), F.when(F.col("by_suffix").isNull(), top).otherwise(
                _share(without_own("by_suffix"), top))))))
    # The suffix is in the prior where there is a host; markup is evidence of its own.
    fused = F.zip_with(F.zip_with("post", prior, lambda a, b: F.greatest(a, F.lit(1e-12)) * b),
                       ratio("by_markup"), lambda a, b: a * b)
    names = F.array(*map(F.lit, langs))

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return joined.withColumn("fused", fused).select(
        *key, best(F.col("fused")).alias("lang"),
        (F.array_max("fused") / F.aggregate("fused", F.lit(0.0), lambda a, x: a + x))
        .alias("probability"), best(F.col("post")).alias("text_lang"))
