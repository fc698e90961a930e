"""Corpus pipeline: five training-data stages, each a Spark job over what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet under the checkpoint folder and reads it again as the next stage's documents. Columns of any
name pass through all stages but the last, which returns shards and slots. Nulls, empty tables,
repeated rows and ties are handled as each operator states.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from vigilbus.llm import decontaminate, mixing, ngram_join, quality, sharding
from vigilbus.llm.columns import boxed, unboxed
from vigilbus.llm.registry import table
from vigilbus.queries.registry import Query
from vigilbus.session import ensure_checkpoint_dir

SHARDS = 8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels of ``docs``, predicts as good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(boxed(docs, "doc_id", "text"), model)
    return unboxed(scored.where("predicted = 1"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by n-gram Jaccard similarity."""
    return ngram_join.one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no, or hardly any, benchmark windows."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts towards the sources' target weights."""
    rows = boxed(docs, "doc_id", "source", "text")
    return unboxed(mixing.poisson_mix(rows, mixing.repetition_rates(docs)))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, copies included."""
    return sharding.shard_slots(docs, SHARDS)


STAGES = [
    ("quality", keep_good),
    ("near_copies", one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier is trained, so no SQL gives the rows; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query("pipeline", run, ORACLE_SQL)
