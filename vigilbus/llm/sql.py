"""DuckDB statements equal to the queries that SQL can express."""

from __future__ import annotations

from vigilbus.llm import line_rules
from vigilbus.llm.sharding import MULTIPLIER

_KEY = "md5(coalesce(doc_id::VARCHAR, ''))"


def _jump(shards: int, name: str) -> str:
    """Chained steps of the jump hash: each step runs while the next shard is within range."""
    parts = [f"{name}0 AS (SELECT k, (('0x' || k[1:16])::UBIGINT)::HUGEINT AS s, -1::BIGINT AS b, "
             f"0::BIGINT AS j FROM keys)"]
    for i in range(shards):
        step = f"((s * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT)"
        ahead = f"floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((({step} // 8589934592) + 1)::DOUBLE)))"
        parts.append(
            f"{name}{i + 1} AS (SELECT k, CASE WHEN j < {shards} THEN {step} ELSE s END AS s, "
            f"CASE WHEN j < {shards} THEN j ELSE b END AS b, "
            f"CASE WHEN j < {shards} THEN {ahead}::BIGINT ELSE j END AS j FROM {name}{i})")
    return ",\n".join(parts)


JUMP_SHARDS = f"""
WITH keys AS (SELECT DISTINCT {_KEY} AS k FROM documents),
{_jump(8, 'a')},
{_jump(9, 'g')},
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
sized AS (
  SELECT doc_id, {_KEY} AS k, coalesce(strlen(text), 0) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8))) AS crc
  FROM documents CROSS JOIN crc_table)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, a8.b::INT AS shard,
  (row_number() OVER (PARTITION BY a8.b ORDER BY doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot,
  g9.b::INT AS grown_shard
FROM sized JOIN a8 USING (k) JOIN g9 USING (k)
"""

_DRAW = "md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, '~'), coalesce(md5(text), '~')))"
POISSON_MIX = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(bytes, 0.5) * ((SELECT sum(bytes) FROM sizes) /
    (SELECT sum(pow(bytes, 0.5)) FROM sizes)) / bytes AS rate FROM sizes),
draws AS (
  SELECT d.*, r.rate, {_DRAW} AS digest FROM documents d
  JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
uniform AS (
  SELECT DISTINCT digest, rate,
    ((('0x' || md5(digest || '/1')[1:13])::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM draws),
inverted AS (
  SELECT digest, rate, u, 0::BIGINT AS k, exp(-rate) AS p, exp(-rate) AS c FROM uniform
  UNION ALL
  SELECT digest, rate, u, k + 1, p * rate / (k + 1), c + p * rate / (k + 1)
  FROM inverted WHERE c < u AND k < ceil(rate + sqrt(rate) * 12 + 40)),
counts AS (SELECT digest, rate, max(k) AS copies FROM inverted GROUP BY digest, rate)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies, copy,
  ('0x' || md5(digest || '#' || copy)[1:15])::BIGINT AS shuffle_key
FROM (SELECT d.*, c.copies, unnest(range(1, c.copies + 1)) AS copy
      FROM draws d JOIN counts c ON d.digest = c.digest AND d.rate = c.rate)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS m
       FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
tests AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM iw)),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw CROSS JOIN (SELECT DISTINCT m FROM iw))),
hits AS (SELECT p.doc_id, p.i, p.m, t.item FROM places p JOIN tests t ON p.m = t.m AND p.s = t.s),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+')"
JACCARD_GROUPS = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b
  ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""

# The bytes of a text as a string of hexadecimal digits, two a byte.
REPEATED_BYTES = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS bin,
  hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n
             FROM documents),
starts AS (SELECT doc_id, i, bin[i + 1:i + 50] AS w
           FROM (SELECT doc_id, bin, unnest(range(n - 49)) AS i FROM raw WHERE n >= 50)),
least AS (SELECT w, min(doc_id) AS low FROM starts GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM starts JOIN least USING (w) WHERE doc_id > low),
marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit),
spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 50 AS e
  FROM (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END)
          OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
  GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS from_byte FROM spans),
kept AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS tail,
    string_agg(substr(h, 2 * from_byte + 1, 2 * (s - from_byte)), '' ORDER BY s) AS body
  FROM cuts JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(body || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""

NEAREST_CODES = """
WITH bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
codes AS (
  SELECT vec_id, list_sum(list_transform(range(len(b)),
    lambda i: b[i + 1]::UBIGINT::HUGEINT << i::INT))::UBIGINT AS code FROM bits),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM codes q CROSS JOIN codes c WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank,
  neighbour_id, distance
FROM pairs
QUALIFY rank <= 10
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PLAIN = ("translate(trim(line, " + _BLANKS + "), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


LINE_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), {_text(line_rules.WORD)}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeats AS (
  SELECT doc_id, sum(least(3, coalesce(gap, 3))) AS n
  FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM again)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, count(*) AS times, regexp_extract_all(line, {_text(line_rules.WORD)}) AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, {_text(line_rules.WORD)}) GROUP BY doc_id, line),
judged AS (
  SELECT doc_id, times, len(array_to_string(lw, '')) AS chars,
    regexp_matches(line, {_text(line_rules.SENTENCE)})
    AND 2 * len(list_filter(lw, lambda x: regexp_matches(
      right(rtrim(x, '.,;:'), 2), {_text(line_rules.MARKS)}))) <= len(lw)
    AND NOT (bare >= 2 AND 4 * bare >= len(lw))
    AND NOT (len({_PLAIN}) <= {line_rules.MENU_CHARS}
      AND regexp_matches({_PLAIN}, {_text(line_rules.MENU)}))
    AND NOT ({" OR ".join(f"contains({_PLAIN}, {_text(p)})" for p in line_rules.BOILERPLATE)}) AS good
  FROM (SELECT *, len(list_filter(lw, lambda x: regexp_matches(
          x, {_text(line_rules.SEPARATORS)}))) AS bare FROM lines)),
held AS (
  SELECT doc_id, sum(times) AS n_lines, sum(times - 1) AS dups,
    sum(times - CASE WHEN good THEN 1 ELSE 0 END) AS failed,
    sum(CASE WHEN good THEN chars ELSE 0 END) AS chars
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(translate(t, '{line_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(failed, 0)::BIGINT AS n_failed_lines,
    (len(array_to_string(w, '')) - coalesce(chars, 0))::BIGINT AS lost_chars
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN held USING (doc_id)),
based AS (
  SELECT *, n_words < {line_rules.MIN_WORDS}
    OR 100 * n_repeat_words > {line_rules.MAX_REPEATED} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * lost_chars <= {line_rules.MAX_LOST} * word_chars AS kept FROM based
"""


_SQUARED = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - x[j]) * (v[j] - x[j])))"
# Floor of the mean of whole numbers, negative ones included.
_MEAN = "((sum(part) - ((sum(part) % count(*) + count(*)) % count(*))) // count(*))::BIGINT"


def _round(i: int) -> str:
    """Vectors to their nearest centroids, then the centroids to their vectors' mean."""
    return f"""
near{i} AS MATERIALIZED (
  SELECT row, arg_min(number, {_SQUARED}::HUGEINT * 8 + number) AS cluster
  FROM whole CROSS JOIN at{i} GROUP BY row),
at{i + 1} AS MATERIALIZED (
  SELECT a.number, coalesce(m.x, a.x) AS x FROM at{i} a LEFT JOIN (
    SELECT cluster, list(c ORDER BY j) AS x FROM (
      SELECT cluster, j, {_MEAN} AS c FROM (
        SELECT cluster, unnest(range(1, 65)) AS j, unnest(v) AS part FROM near{i} JOIN whole USING (row))
      GROUP BY cluster, j) GROUP BY cluster) m ON a.number = m.cluster)"""


_ROUNDS = ",".join(_round(i) for i in range(10))
CLUSTERS = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
at0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS number,
    v AS x FROM whole QUALIFY number < 8),{_ROUNDS},
measured AS (
  SELECT row, vec_id, number, x, {_SQUARED}::BIGINT AS distance FROM whole CROSS JOIN at10),
assigned AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, number) AS place FROM measured)
SELECT vec_id, number::INT AS cluster, distance,
  sum(distance) OVER (PARTITION BY number)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM (SELECT * FROM assigned WHERE place = 1)
"""

_GAP = "((p - q) * (p - q)) // (p + q)"
SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
terms AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term
          HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM terms GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words
           JOIN terms USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS n_lang,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN terms t ON g.lang = t.lang LEFT JOIN counts c
  ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
shares AS (
  SELECT lang, source, term, c.n,
    1 + 1000000000 * (c.n + 2) // (total + 2 * v) AS p,
    1 + 1000000000 * (n_lang + 2) // (l.n + 2 * v) AS p_lang
  FROM cells c JOIN langs l USING (lang)),
summed AS (
  SELECT lang, source, item, sum({_GAP}) AS value
  FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM shares a
        JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
  GROUP BY lang, source, item),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
foremost AS (
  SELECT lang, source, 'term' AS part, term AS item, {_GAP} AS value
  FROM (SELECT *, p_lang AS q FROM shares) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM foremost))
WHERE part = 'pair' OR rank <= 10
"""
