"""Every registered query against its SQL twin, or its plain properties where SQL can't say it."""

import pytest
from compare import connect, differences

import corpus_pipeline
from vigilbus.llm.queries import QUERIES

CHECKED = [n for n, q in QUERIES.items() if q.sql]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, con, name):
    assert differences(spark, con, QUERIES[name].run, QUERIES[name].sql, sf) is None


def test_dealt_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_copies", "decontamination", "mixing", "sharding"]


def test_pipeline_keeps_what_every_stage_keeps(spark, sf):
    """Each stage against its own operator's digest over the same input."""
    from vigilbus.llm import decontaminate, ngram_join, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    good = corpus_pipeline.keep_good(spark, docs, sf).cache()
    scored = quality.score_quality(docs, quality.train(docs, labels))
    assert ids(good) == ids(scored.where("score >= 0.5"))
    single = corpus_pipeline.one_of_near_copies(spark, good, sf).cache()
    assert ids(single) == ids(ngram_join.ngram_groups(good).where("doc_id = component_id"))
    assert single.columns == docs.columns
    clean = corpus_pipeline.drop_benchmark(spark, single, sf).cache()
    found = decontaminate.find_benchmark(single, benchmark)
    assert ids(clean) == ids(found.where("NOT contaminated"))
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    assert ids(mixed) <= ids(clean) and mixed.columns == docs.columns
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == mixed.count()
    slots = final.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in slots)
