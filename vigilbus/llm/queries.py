"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilbus.llm import sql
from vigilbus.llm.registry import QUERIES, query, table

__all__ = ["QUERIES"]

SHARDS = 8
#: File of a public tokenizer; another one can be named in the environment.
VOCABULARY = os.environ.get("UNIGRAM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@query("op2_jump_hash_shards", sql.JUMP_SHARDS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.sharding import shard_slots

    return shard_slots(table(spark, sf_dir, "documents"), SHARDS)


@query("op6_poisson_mix", sql.POISSON_MIX)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.mixing import poisson_mix, repetition_rates

    docs = table(spark, sf_dir, "documents")
    mixed = poisson_mix(docs, repetition_rates(docs))
    return mixed.withColumn("rate", F.round("rate", 9))


@query("op4_wu_manber_decontamination", sql.DECONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.decontaminate import find_benchmark

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op9_crf_line_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op7_divideskip_jaccard_join", sql.JACCARD_GROUPS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents"))


@query("op3_information_sanitiser")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.pii import KINDS, find_personal, span_list

    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"))


@query("op10_radix_suffix_dedup", sql.REPEATED_BYTES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


@query("op5_trie_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.token_counts import count_tokens, unigram_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(spark, docs, unigram_scores(VOCABULARY))
    return counted.select("doc_id", "n_pretokens", "n_tokens")


@query("op8_multi_index_hashing", sql.NEAREST_CODES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.hamming import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op1_bayes_language_fusion")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages and of all documents; a document's source stands for its host."""
    from vigilbus.llm.langid import identify, page_evidence, train

    docs = table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    pages = page_evidence(table(spark, sf_dir, "pages")).select(
        nothing.cast("long").alias("doc_id"), "page_id", "evidence_text", "host", "domain",
        "suffix", "markup")
    texts = docs.select(
        "doc_id", nothing.cast("long").alias("page_id"), F.col("text").alias("evidence_text"),
        F.col("source").alias("host"), nothing.alias("domain"), nothing.alias("suffix"),
        nothing.alias("markup"))
    return identify(pages.union(texts), train(docs), ["doc_id", "page_id"])


@query("op11_line_first_rules", sql.LINE_RULES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.line_rules import REPORT, judge_documents

    return judge_documents(table(spark, sf_dir, "documents"), cleaned=False).select(
        "doc_id", *REPORT)


@query("op12_equal_average_clusters", sql.CLUSTERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from vigilbus.llm.centroids import cluster, with_inertia

    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
                        for row in centroids.tolist()]).cast("array<string>")
    return with_inertia(assigned).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.get(digests, F.col("cluster")).alias("centroid_sha256"))


@query("op13_source_divergence", sql.SOURCE_DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilbus.llm.source_audit import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"))
