"""Input columns called like an operator's own helpers or results come through untouched."""

import pytest

import corpus_pipeline
from vigilbus.llm import decontaminate, mixing, ngram_join, pii

NAMES = ("mark", "row_mark", "rate_source", "draw_digest", "found", "counted", "rate", "copies", "copy",
         "shuffle_key", "n_words", "hit_runs", "contaminated", "score", "held_out", "predicted", "_row",
         "body", "group", "component", "first", "root", "spans_")
WORDS = "the quick brown fox jumps over a lazy dog while it rains in spring and summer too"


@pytest.fixture(scope="module")
def docs(frame):
    """Two copies, one other text, one with a benchmark passage, one with an address, one null."""
    texts = [WORDS, WORDS, WORDS[::-1], "x y " + " ".join(f"item{i}" for i in range(14)),
             "write to someone@example.org today please", None]
    rows = [(i, t, "en", f"s{i % 2}", *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return frame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(
        f"`{n}` string" for n in NAMES)).cache()


def rows(df, docs):
    assert df.columns == docs.columns
    return {tuple(r) for r in df.collect()}


def given(docs, *ids):
    return {tuple(r) for r in docs.collect() if r.doc_id in ids}


def test_one_per_group(docs):
    assert rows(ngram_join.one_per_group(docs), docs) == given(docs, 0, 2, 3, 4, 5)


def test_decontaminated(spark, docs):
    items = spark.createDataFrame([("i", " ".join(f"item{i}" for i in range(14)))], "item_id string, text string")
    assert rows(decontaminate.decontaminated(docs, items), docs) == given(docs, 0, 1, 2, 4, 5)


def test_sanitise(docs):
    out = pii.sanitise(docs)
    assert out.columns == [*docs.columns, "spans", "sanitised"]
    got = {r.doc_id: r for r in out.collect()}
    assert "[email]" in got[4].sanitised and got[4].row_mark == "row_mark-4"


def test_poisson_mix(docs):
    kept = [c for c in docs.columns if c not in mixing.ADDED]
    mixed = mixing.poisson_mix(docs, mixing.repetition_rates(docs))
    assert mixed.columns == [*kept, *mixing.ADDED]
    assert {tuple(r) for r in mixed.select(kept).collect()} <= {tuple(r) for r in docs.select(kept).collect()}


def test_stages_return_the_input_columns(spark, docs, sf, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert rows(mixed, docs) <= given(docs, *range(6))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert rows(corpus_pipeline.keep_good(spark, docs, str(tmp_path)), docs) <= given(docs, *range(6))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
