"""Decontamination, token counts, personal data and quality against brute force and edge cases."""

import math
import random
import re

import pytest

from vigilbus.llm import decontaminate, pii, quality, token_counts


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def plain_hits(text, items):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = alnum_words(body)
        m = min(13, len(iw))
        tests = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)} if iw else set()
        for i in range(len(words) - m + 1) if tests else ():
            if tuple(words[i:i + m]) in tests:
                hit.update(range(i, i + m))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 25, 60])
def test_decontamination_equals_brute_force(frame, block_bytes):
    rng = random.Random(3)
    pool = ["a", "B", "c9", "é", "dd"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)]
    items += [(None, text(13)), (3, text(20)), (40, None), (41, ""), (42, "...")]
    docs = [(i, text(rng.randint(0, 60)) + (" x. " + items[i % 12][1] if i % 2 else ""))
            for i in range(60)] + [(None, None), (61, ""), (62, "--"), (5, "a B c9"), (63, text(9000))]
    got = decontaminate.find_benchmark(
        frame(docs).selectExpr("*", "1 AS n_words", "2 AS found", "text AS hit_items"),
        frame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = sorted((-1 if d is None else d, *plain_hits(t, items)) for d, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.hit_items)
                  for r in got) == want
    for r in got:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_decontamination_without_benchmark(frame):
    empty = frame([], "item_id long, text string")
    assert decontaminate.decontaminated(frame([(1, "a b"), (2, None)]), empty).count() == 2
    assert decontaminate.find_benchmark(frame([]), empty).count() == 0


def best_cut(word, scores, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        if word[end - 1] not in scores:
            s, k = best[end - 1]
            options.append((s + unknown, k + len(word[end - 1].encode())))
        for start in range(end):
            if word[start:end] in scores:
                s, k = best[start]
                options.append((s + scores[word[start:end]], k + 1))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts_equal_brute_force(spark, frame):
    rng = random.Random(5)
    scores = {p: -rng.randint(1, 30) / 4 for p in
              ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aab", "bbb", "abab", "▁ba", "bab"]}
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
                      for _ in range(rng.randint(0, 30))) for _ in range(50)]
    texts += [None, "", " \n ", "ab" * 5000]
    unknown = min(scores.values()) - token_counts.UNKNOWN_BELOW
    docs = frame(list(enumerate(texts))).selectExpr("*", "0 AS n_tokens", "1 AS counted_before")
    for r in token_counts.count_tokens(spark, docs, scores).collect():
        words = (texts[r.doc_id] or "").split()
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(best_cut("▁" + w, scores, unknown) for w in words)


def test_token_counts_equal_a_unigram_tokenizer(spark, sf):
    from tokenizers import Tokenizer, models

    from vigilbus.llm.queries import VOCABULARY

    scores = token_counts.unigram_scores(VOCABULARY)
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], unk_id=0))
    trie = token_counts.PieceTrie(scores)
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").limit(20).collect()
    words = sorted({"▁" + w for r in rows for w in r.text.split() if w.isascii()})
    same = [(w, n, len(model.encode(w).ids)) for w, n in trie.counts(words)]
    # The two may break exact score ties differently.
    assert sum(n == m for _, n, m in same) >= 0.995 * len(same)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(frame):
    rng = random.Random(9)
    bits = ["a@b.co", "x.y+z@w-1.org.uk", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "é😀", "@", ".",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+44", " ", "-", "7",
            "a@b.co@c.de", "1.2.3.4.5.6.7.8", "+12345678901x", "word", "__%", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "9" * 30000, "a" * 30000, "+" * 300, "1.1 " * 3000, "a@b.co " * 1500]
    got = pii.find_personal(frame(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [tuple(s) for s in r.spans if s["kind"] in pii.KINDS]
        assert base == plain_spans(texts[r.doc_id])


def test_revealing_terms_and_clean_documents(frame):
    rows = [(i, "Vortex specialist writes to ann@corp.example about things that everybody knows")
            for i in range(3)]
    rows += [(10 + i, f"things that everybody knows about, number {i}, writes to nobody") for i in range(40)]
    rows += [(60, "mail bob@corp.example and nothing else"), (61, None)]
    got = {r.doc_id: r for r in pii.sanitise(frame(rows).selectExpr("*", "1 AS spans")).collect()}
    assert len(got) == len(rows)
    assert got[0].sanitised == "  writes to [email] about things that everybody knows"
    assert {(s.kind, s.start, s.end) for s in got[0].spans} == {
        ("remove", 0, 6), ("remove", 7, 17), ("email", 28, 44)}
    assert all(not got[i].spans and got[i].sanitised == rows[i - 7][1] for i in range(10, 50))
    assert [s.kind for s in got[60].spans] == ["email"] and got[61].sanitised == ""
    assert pii.find_personal(frame([])).count() == 0


def test_terms_are_paired_over_whole_documents(frame):
    """Against plain loops, with terms far away, short, between blankless text and other matches."""
    rng = random.Random(4)
    far = " ".join(["plain"] * 60)
    people = [("ann@corp.example", "Zyx", "Ng"), ("10.1.2.3", "Quorl", "Li"),
              ("+1 555 010 9999", "王小明", "Vantor")]
    texts = []
    for entity, *names in people:
        for i in range(3):
            near = " ".join(rng.sample(["some", "of", "the", "words"], 3))
            texts.append(f"{names[0]}。{far} {near} {entity} {entity}\t{'x' * 90} {far} {names[1]}")
        texts.append(f"{far} {names[1]} some of the words")
    texts += ["plain words of the sort that some say"] * 60 + [texts[0], None]
    rows = [*enumerate(texts), (0, texts[0])]
    docs = [(i, t, {s[3] + ":" + re.sub("[^0-9]" if s[3] == "phone" else "$", "", t[s[0]:s[2]])
                    for s in plain_spans(t)}, set(re.findall(r"[^\W\d_]+", (t or "").lower())))
            for i, t in rows]
    expected = {}
    for c in set().union(*(d[2] for d in docs)):
        held = [d for d in docs if c in d[2]]
        for t in set().union(*(d[3] for d in held)):
            both, of = sum(t in d[3] for d in held), sum(t in d[3] for d in docs)
            pmi, ic = math.log2(len(docs) * both / (len(held) * of)), math.log2(len(docs) / len(held))
            if both >= pii.SUPPORT and pmi >= pii.THRESHOLD * ic:
                for d in held:
                    at = expected.setdefault(d[0], {})
                    at[t] = "remove" if both == of else at.get(t, "general")
    assert expected[0]["zyx"] == "remove" and "ng" in expected[0]
    got = pii.find_personal(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        base = plain_spans(text)
        want = [(m.start(), m.end(), expected[r.doc_id][m[0].lower()])
                for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in expected.get(r.doc_id, {})]
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind not in pii.KINDS] == [
            w for w in want if all(w[1] <= b[0] or b[2] <= w[0] for b in base)]


def test_quality_learns_from_labels_alone(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.5 for s in good) >= 0.98 * len(good)


def test_quality_learns_from_tails_of_long_documents(frame, monkeypatch):
    """Labelled texts that differ after 450 lines only; then fewer documents, but whole ones."""
    same = "One plain line of words.\n" * 450
    texts = [same + ("Good plain line.\n" if i % 2 else "%%% $$$ ###\n") * 50 for i in range(24)]
    docs = frame(list(enumerate(texts)))
    labels = frame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    tails = frame([(0, "%%% $$$ ###\n" * 9), (1, "Good plain line.\n" * 9)])
    model = quality.train(docs, labels)
    score = {r.doc_id: r.score for r in quality.score_quality(tails, model).collect()}
    assert score[1] > score[0] + 0.1
    taken = []
    monkeypatch.setattr(quality, "TRAIN_LINES", 1100)
    monkeypatch.setattr(quality, "fit", lambda owns, labels: taken.extend(map(len, owns)))
    quality.train(docs, labels)
    assert taken == [501] * 3


def test_forward_backward_equals_enumeration():
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 5])
    unary, links = rng.normal(size=9), rng.normal(size=(2, 2))
    marginal, expected, log_z = quality.forward_backward(unary, links, quality.Packed(sizes))
    want, pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        u = unary[at:at + n]
        at += n
        weight = {y: math.exp(sum(u[i] * y[i] for i in range(n)) + sum(
            links[a, b] for a, b in zip(y, y[1:], strict=False)))
            for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        total += math.log(z)
        want += [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]
        for y, w in weight.items():
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w / z
    assert np.allclose(marginal, want) and np.allclose(expected, pairs) and math.isclose(log_z, total)


def test_quality_edge_cases(frame):
    labels = frame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)],
                   "doc_id long, quality int, toxic int")
    docs = frame([(i, "Good plain line.\nAnother one." if i % 2 else "%%% $$$ ###") for i in range(40)]
                 + [(90, None), (91, ""), (None, "x"), (92, "\n" * 3000), (1, "repeated id")])
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs.selectExpr("*", "'x' AS score"), model).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    nothing = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {1.0}
    assert quality.score_quality(frame([]), model).count() == 0
    empty = quality.train(docs, labels.where("false"))
    assert quality.score_quality(docs, empty).first().score == 0.5
