"""Near copies, repeated windows, nearest codes and languages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from vigilbus.llm import hamming, langid, ngram_join, packed, suffix_dedup
from vigilbus.llm.components import components


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and 100 * k >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def corpus(seed, groups=6, copies=14):
    """Groups of copies with few and many edits, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 18))):
                words[rng.randrange(len(words))] = word()
            if g % 3 == 1:
                words += passage
            rows.append((rng.randrange(10**6), " ".join(words)))
    rows += [(rng.randrange(10**6), " ".join([word() for _ in range(150)] + passage)) for _ in range(20)]
    rows += [(1, "One two"), (2, "one  TWO"), (3, "one"), (4, ""), (5, None), (6, " \n"), (None, "one two"),
             (7, rows[0][1]), (7, rows[0][1]), (None, "only null here"), (8, "x" * 50_000)]
    return rows


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("seed, short", [(1, 8), (2, 2), (3, 1)])
def test_groups_equal_brute_force(frame, seed, short):
    rows = corpus(seed)
    got = ngram_join.ngram_groups(
        frame(rows, parts=9).selectExpr("*", "1 AS n", "2 AS root", "3 AS cid", "4 AS mark"),
        short=short).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_groups(rows), key=key)


def test_one_document_of_each_group(frame):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words in this text here"), (4, None),
            (5, None), (1, "A b c d e f"), (6, "")]
    kept = ngram_join.one_per_group(frame(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [
        (1, "A b c d e f"), (2, "other words in this text here")]
    assert sorted(r.doc_id for r in kept if not r.text) == [4, 5, 6]
    assert ngram_join.one_per_group(frame([])).count() == 0
    assert ngram_join.ngram_groups(frame([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 180)] + [(9, 9)]
    edges += [(300 + i, 300 + rng.randrange(40)) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def plain_repeats(rows):
    large = 2**63
    starts = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            starts.setdefault(raw[i:i + 50], []).append(large if doc is None else doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if min(starts[raw[i:i + 50]]) < (large if doc is None else doc):
                gone[i:i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for _ in range(60):
        text = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            text += p[cut:] + some(rng.choice([0, 1, 60]))
        rows.append((rng.randrange(1000), text))
    rows += [(5, None), (6, ""), (None, passages[4]), (1001, "a" * 700), (1002, "a" * 300), (7, rows[3][1]),
             (7, rows[3][1]), (0, passages[4] * 2)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    docs = spark.read.parquet(path).selectExpr("*", "1 AS kept", "2 AS body", "3 AS g")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(plain_repeats(rows), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_packed_bytes_round_trip():
    values = np.array([0, 1, 2**40, 2**48 - 1], np.uint64)
    assert (packed.uncut(packed.cut(values, 6), 6) == values).all()
    assert (packed.expand(packed.squeeze(values), np.uint64) == values).all()


def test_nearest_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 64))
    vectors[50:150] = vectors[50]
    vectors[150:200] = np.where(rng.random((50, 64)) < 0.03, -vectors[50], vectors[50])
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, rows[0][1]), (900, None), (901, [float("nan")] * 64), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS code", "2 AS segment")
    got = {}
    for r in hamming.search(df, df.where("vec_id % 40 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbour_id))

    def code(v):
        return sum(1 << i for i, x in enumerate(v) if x > 0)

    held = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    for i, c in held:
        if i % 40 == 0:
            want = sorted(((c ^ d).bit_count(), j) for j, d in held)[:7]
            assert sorted(got[i]) == want
    assert hamming.search(df.where("false"), df.where("vec_id = 0")).count() == 0
    few = df.where("vec_id < 3")
    assert hamming.search(few, few.where("vec_id = 0"), k=7).count() == 3


def test_language_evidence(spark, frame):
    rows = [(i, "the cat and the dog with them", "en") for i in range(20)]
    rows += [(50 + i, "der hund und die katze mit ihnen", "de") for i in range(20)]
    docs = spark.createDataFrame(rows + [(99, None, "en"), (98, "what", None)],
                                 "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["langs"] == ["de", "en"]
    page = "<html lang='{0}'><script>x</script><body>{1}</body></html>"
    pages = spark.createDataFrame(
        [(i, "https://www.tier.de/a", page.format("de", "der hund und die katze")) for i in range(12)]
        + [(20 + i, "https://pets.example.com/en/a", page.format("en", "the cat and the dog"))
           for i in range(12)]
        + [(40, "http://tier.de/b", "<html><body></body></html>"), (41, None, None),
           (42, "http://x.com", page.format("en", "")), (43, "nonsense", "the dog and the cat"),
           (20, "https://pets.example.com/", "<p>the cat</p>")],
        "page_id long, url string, html string")
    got = langid.identify(langid.page_evidence(pages), model, ["page_id"]).collect()
    assert len(got) == 29
    lang = {r.page_id: r.lang for r in got}
    assert all(lang[i] == "de" for i in range(12)) and all(lang[20 + i] == "en" for i in range(12))
    assert lang[40] == "de"  # no text: its host decides
    assert lang[42] == "en"  # no text: its markup decides
    assert lang[43] == "en" and lang[41] in ("de", "en")
    assert all(0 < r.probability <= 1 for r in got)
    nothing = langid.train(docs.where("false"))
    assert langid.identify(langid.page_evidence(pages), nothing, ["page_id"]).first().lang is None
    assert langid.identify(langid.page_evidence(pages.where("false")), model, ["page_id"]).count() == 0


def test_language_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 3 <> 0"))
    rows = docs.where("doc_id % 3 = 0").selectExpr(
        "doc_id", "text AS evidence_text", "source AS host", "string(null) AS domain",
        "string(null) AS suffix", "string(null) AS markup")
    got = langid.identify(rows, model, ["doc_id"]).join(
        docs.selectExpr("doc_id", "lang AS truth"), "doc_id").collect()
    assert sum(r.lang == r.truth for r in got) >= 0.98 * len(got)
