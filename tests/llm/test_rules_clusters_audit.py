"""Line rules, centroid clustering and source audit against plain loops, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilbus.llm import centroids, line_rules, source_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "one fine line of plain words that ends as it should."


def plain_report(text):
    """The fixed columns of a text, by counting."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def noise(seed, words, vocabulary):
    rng = random.Random(seed)
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t ", " \x0b"])
                   for _ in range(words))


TEXTS = [
    None, "", " \n\t\n ", "a", "a b", "a a a", "a a a a", "x y x y x y x", "é ü ß \U0001f600 z",
    noise(1, 400, ["a", "bb", "c.", "ß!", "#x", "d"]), noise(2, 300, [f"w{i}" for i in range(250)]),
    noise(3, 60, ["the"]), noise(4, 30_000, [f"t{i}" for i in range(5_000)]), "#" * 5000, "| " * 300,
]


def test_line_rules_base_columns(spark, frame):
    docs = frame([(i, t) for i, t in enumerate(TEXTS + TEXTS)])
    rows = line_rules.judge_documents(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain_report((TEXTS + TEXTS)[r.doc_id])


@pytest.mark.parametrize("line, bad", [
    (GOOD, False), ("no end here at all", True), ("a first sentence. then a torn one", False),
    ("He said “so it is.”", False), ("Home | News | Sport | About.", True), ("SIGN IN", True),
    ("BUY!! NOW!! CHEAP!! BEST!!", True), ("Wow!! That was a fine day for all of us.", False),
    ("Licensed under the Apache License, Version 2.0.", True), ("All RIGHTS Reserved.", True),
    ("你好。", False), ("a* b** c## d&&.", True),
])
def test_a_line_alone(spark, frame, line, bad):
    row = line_rules.judge_documents(frame([(1, line)])).first()
    assert (row.n_failed_lines, row.cleaned) == ((1, "") if bad else (0, line))


def test_failing_lines_go_and_losing_much_rejects(spark, frame):
    body = [" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(10)]
    light = "\n".join([*body, "Privacy Policy", "", body[0]])
    heavy = "\n".join([*body, *[f"{i}torn {i}line {i}that {i}goes {i}on {i}with {i}no {i}end" for i in range(9)]])
    docs = frame([(1, light, "u", 7), (2, heavy, "v", 8), (3, None, "w", 9)],
                 "doc_id long, text string, kept string, `_judged` int")
    stays = line_rules.clean_documents(docs)
    assert stays.columns == docs.columns
    assert [tuple(r) for r in stays.collect()] == [(1, "\n".join(body), "u", 7)]
    judged = {r.doc_id: r for r in line_rules.judge_documents(docs).collect()}
    assert judged[1].n_failed_lines == 2 and judged[1].kept and not judged[2].kept
    assert not judged[2].base_failed
    assert line_rules.judge_documents(docs.limit(0)).count() == 0


# Centroids ---------------------------------------------------------------------------------------

def plain_clusters(rows, k, dims, rounds, seed):
    """{row place: (cluster, distance)} and centroids, by comparing with every centroid."""
    kept = []
    for place, (vid, v) in enumerate(rows):
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((place, vid, [math.floor(1024 * x) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(
        f"{seed}:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))
    cents = [r[2] for r in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(col) // len(groups[i]) for col in zip(*groups[i], strict=True)] if i in groups else c
                 for i, c in enumerate(cents)]
    return sorted((-1 if vid is None else vid, near(v)[1], near(v)[0]) for _, vid, v in kept), cents


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims))
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 5] + rng.normal(size=dims) * 0.4])
            for i in range(n)]
    flat = [0.25] * dims
    odd = [(n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [None] + [0.0] * (dims - 1)),
           (n + 4, [math.nan] + [0.0] * (dims - 1)), (n + 5, [math.inf] + [0.0] * (dims - 1)),
           (None, flat), (3, flat), (3, flat), (7, [-9.5] * dims), (n + 6, [0.0] * dims)]
    return rows + odd + [(i + 10 * n, rows[0][1]) for i in range(40)]


@pytest.mark.parametrize("dims, k, rounds", [(8, 8, 10), (3, 5, 4), (1, 4, 3)])
def test_clusters_equal_full_comparison(spark, dims, k, rounds):
    rows = vectors(300, dims, dims)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, embedding array<float>, distance int, v string").repartition(5)
    got, cents = centroids.cluster(df, k=k, dims=dims, rounds=rounds)
    want, want_cents = plain_clusters(rows, k, dims, rounds, 3)
    assert cents.tolist() == want_cents
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance)
                  for r in got.collect()) == want
    sums = centroids.with_inertia(got).collect()
    assert {r.inertia for r in sums} == {sum(d for _, _, d in want)}
    part = Counter()
    for _, c, d in want:
        part[c] += d
    assert all(r.cluster_inertia == part[r.cluster] for r in sums)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(3)], schema)
    got, cents = centroids.cluster(three, k=8, dims=2)
    assert len(cents) == 3 and {r.distance for r in got.collect()} == {0}
    for none in (three.limit(0), spark.createDataFrame([(1, None), (2, [1.0])], schema)):
        got, cents = centroids.cluster(none, k=8, dims=2)
        assert len(cents) == 0 and centroids.with_inertia(got).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), dims=2)


def test_search_is_exact_and_passes_over_centroids(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2000, 2000, (500, 16))
    cents = np.vstack([x[:30], x[:4], np.roll(x[:6], 3, axis=1)])
    number, distance = centroids.nearest(x, centroids.Centroids.of(cents))
    full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all()
    assert (number == full.argmin(axis=1)).all()
    squares = np.array([0, 1, 2, 3, 4, 2**62, 2**62 - 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1])
    assert centroids.root(squares).tolist() == [math.isqrt(int(v)) for v in squares]


# Source audit ------------------------------------------------------------------------------------

def plain_audit(docs, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = term.findall((text or "").translate(low))
        held[lang or ""].update(set(words))
        counts[(lang or "", source or "")].update(words)
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        mine = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        by = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        for s, p in by.items():
            pairs = [(sum(f(p[t], by[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(f(p[t], q[t]), t) for t in kept if mine[s][t] and p[t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows[:most])}
    return out


def audit_rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "é", "Éa", "straße", "x1y", "zz", "kind", "of", "the", "你好"] + [
        f"{a}{b}" for a in "abcdef" for b in "ghij"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 25))) + ".", lang, source)
            for lang, sources in (("en", ["s1", "s2", "s3", "", None]), ("de", ["s1"]), (None, ["q", "r"]))
            for source in sources for _ in range(12)]
    return rows + [(None, "en", "s9"), ("", "xx", "y"), ("1 2 3", "xx", "z"), ("lone words", "xx", "y"),
                   ("straße " * 4000, "en", "s1")] + [("the same text", "en", "s2")] * 30


@pytest.mark.parametrize("bits, sent", [(64, None), (3, None), (5, 1)])
def test_audit_equals_plain_sums(spark, monkeypatch, bits, sent):
    """Short digests collide, so the split is used; with a low limit, strings shuffle first."""
    if sent is not None:
        monkeypatch.setattr(source_audit, "SENT_DIGESTS", sent)
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 5, "d") for r in rows],
                               "text string, lang string, source string, g int, digest string").repartition(4)
    got = source_audit.audit_sources(df, min_docs=4, top=6, bits=bits).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, 4, 6)
    assert len(got) == len({tuple(r) for r in got})


def test_audit_of_nothing(spark):
    schema = "text string, lang string, source string"
    assert source_audit.audit_sources(spark.createDataFrame([], schema)).count() == 0
    lone = spark.createDataFrame([("a b", "en", "s"), (None, None, None), ("c", None, "t")], schema)
    got = {tuple(r) for r in source_audit.audit_sources(lone).collect()}
    assert got == {("", "", "pair", "t", 0, 1), ("", "t", "pair", "", 0, 1)}
