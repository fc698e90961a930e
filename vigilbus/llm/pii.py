"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Personal data (email, ip, card, phone) are found by patterns. Each distinct value is a protected
entity c. Corpus counts over all documents estimate how strongly a term t reveals it:

    PMI(c; t) = log2(N df(c, t) / (df(c) df(t)))        IC(c) = log2(N / df(c))

df(c, t) counts documents that hold both, however far apart, df(t) all documents with t. In a
document that holds c, a term seen with c in ``SUPPORT`` documents at least and with PMI >=
``THRESHOLD`` IC is taken out wherever it stands: generalised, or removed if it occurs with c only
(PMI = IC). Documents without personal data stay as they are. A term is a run of letters of any
length.

Patterns are written so that they find what the plain patterns find, but in linear time and without
recursion on long texts: possessive groups, and starts only where a run of characters starts or the
last match ended. Spans are in code points, end exclusive.

Defined cases: a null text is empty; an empty corpus gives an empty result; rows equal in id and
text are judged alike; a term inside personal data is not reported again; null ids pass through;
input columns called like an added one are replaced.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.llm.columns import boxed, unboxed, without
from vigilbus.session import cut_lineage

# The kinds of personal data and their patterns.
KINDS = ("email", "ip", "card", "phone")
_NAME = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}++"
SUPPORT = 2
THRESHOLD = 0.9
#: Prefix sums run over this many matches at a time, so that arrays grow in short pieces.
_PIECE = 256
ADDED = ("spans", "n_email", "n_ip", "n_card", "n_phone", "sanitised")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>>: all matches.

    The pieces between matches give the positions as running sums of lengths.
    """

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(gap: Column, value: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), value.alias("value"))

    def local(steps: Column) -> Column:
        """End position of a piece and its matches, counted from the piece's start."""
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

        def add(acc: Column, s: Column) -> Column:
            begin = acc["pos"] + s["gap"]
            end = begin + F.length(s["value"])
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
                begin.alias("start"), end.alias("end"), s["value"].alias("value")))).alias("out"))

        return F.aggregate(steps, start, add)

    def shifted(piece: Column, by: Column) -> Column:
        return F.transform(piece["out"], lambda m: F.struct(
            (m["start"] + by).alias("start"), (m["end"] + by).alias("end"),
            m["value"].alias("value")))

    def located(steps: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _PIECE).cast("int")),
            lambda i: local(F.slice(steps, i * _PIECE + 1, F.lit(_PIECE))))
        return _let(pieces, lambda ps: F.flatten(F.transform(ps, lambda p, i: shifted(
            p, F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda a, q: a + q["pos"])))))

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"))
    return _let(found, lambda f: F.when(F.size(f["values"]) == 0, none).otherwise(_let(
        F.transform(f["values"], lambda v, i: step(F.get(f["gaps"], i), v)), located)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right doubled, is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(
            F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """The protected value, however it is written."""
    same = F.translate(value, _UPPER, _LOWER) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(f"{kind}:"), same)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, entity>> by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    gate = {"email": "@", "phone": "+"}
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,entity:string>>")

    def of_kind(rank: int, kind: str) -> Column:
        here = text.contains(gate[kind]) if kind in gate else text.rlike("[0-9]")
        found = F.filter(
            _matches(text, F.lit(PATTERNS[kind])), lambda m: _valid(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), _entity(kind, m["value"]).alias("entity")))
        return F.when(here, spans).otherwise(none)

    kinds = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds))


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """mark, term, removed: terms that reveal an entity of the document with this mark.

    ``found`` has mark, base (spans) and, where there are any, terms of every document. Terms are
    counted by their hash over all documents. Since df(c, t) <= df(c), a term of more than
    N^(1 - THRESHOLD) df(c)^THRESHOLD documents can't disclose c, so such terms are left out before
    they are paired with the entities of their documents.
    """
    total = found.count()
    held = found.where(F.size("base") > 0)
    # Rows equal in id and text have one mark: they are paired once and count as often as they are.
    named = held.select("mark", F.explode(F.array_distinct(F.transform(
        "base", lambda s: s["entity"]))).alias("entity")).groupBy("mark", "entity").agg(
            F.count(F.lit(1)).alias("copies"))
    entities = named.groupBy("entity").agg(F.sum("copies").alias("of_entity")).where(
        (F.col("of_entity") >= SUPPORT) & (F.col("of_entity") < total)).withColumn(
            "most", F.pow(F.lit(float(total)), F.lit(1 - THRESHOLD))
            * F.pow("of_entity", F.lit(THRESHOLD)) * (1 + 1e-9))
    named = cut_lineage(named.join(entities, "entity"))
    limit = named.agg(F.max("most")).first()[0] or 0.0
    terms = docs.select(F.explode(F.array_distinct(F.transform(
        _terms(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t)))).alias("hash")).groupBy("hash").agg(
            F.count(F.lit(1)).alias("of_term")).where(F.col("of_term").between(SUPPORT, limit))
    words = held.select("mark", "terms").join(
        named.groupBy("mark").agg(F.max("most").alias("most")), "mark").dropDuplicates(["mark"]).select(
            "mark", "most", F.explode("terms").alias("term")).withColumn("hash", F.xxhash64("term"))
    rare = cut_lineage(words.join(terms, "hash").where(F.col("of_term") <= F.col("most")).select(
        "mark", "term", "of_term"))
    pairs = named.join(rare, "mark").where(F.col("of_term") <= F.col("most"))
    scored = pairs.groupBy("entity", "term", "of_entity", "of_term").agg(
        F.sum("copies").alias("both")).where(F.col("both") >= SUPPORT)
    pmi = F.log2(F.lit(float(total)) * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    information = F.log2(F.lit(float(total)) / F.col("of_entity"))
    disclosing = scored.where(pmi >= THRESHOLD * information).select(
        "entity", "term", (F.col("both") == F.col("of_term")).alias("removed"))
    return pairs.select("mark", "entity", "term").join(disclosing, ["entity", "term"]).groupBy(
        "mark", "term").agg(F.max("removed").alias("removed"))


def _term_spans(text: Column, terms: Column, kind: str, rank: int) -> Column:
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(terms) > 0, F.transform(
        _matches(F.translate(text, _UPPER, _LOWER), pattern),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                           m["end"].alias("end"), F.lit(kind).alias("kind"))))


_PLAIN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark, spans (start, rank, end, kind): personal data and what reveals it, for every row.

    ``mark`` is the hash of id and text.
    """
    mark = F.xxhash64(key, text)
    based = docs.select(
        F.col(key), mark.alias("mark"), base_spans(F.col(text)).alias("base"), F.col(text).alias("body"))
    found = cut_lineage(based.select(key, "mark", "base", F.when(
        F.size("base") > 0, F.array_distinct(_terms(F.col("body")))).alias("terms")))
    terms = revealing_terms(docs, found, text).groupBy("mark").agg(
        F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("remove"),
        F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("general"))
    texts = docs.select(mark.alias("mark"), F.col(text).alias("body")).join(terms, "mark")
    none = F.array().cast(_PLAIN)
    extra = texts.select("mark", F.concat(
        F.coalesce(_term_spans(F.col("body"), F.col("general"), "general", 4), none),
        F.coalesce(_term_spans(F.col("body"), F.col("remove"), "remove", 5), none),
    ).alias("extra")).dropDuplicates(["mark"])
    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    clear = F.filter("extra", lambda t: ~F.exists("plain", lambda b: (
        b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.withColumn("plain", plain.cast(_PLAIN)).join(extra, "mark", "left").select(
        key, "mark", F.array_sort(F.concat("plain", F.coalesce(clear, none))).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans replaced by their kind in brackets; removed terms leave nothing."""

    def cut(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        put = F.when((s["kind"] == "remove") | (s["start"] < acc["pos"]), F.lit("")).otherwise(
            F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.concat(acc["out"], kept, put).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(spans, start, cut, lambda a: F.concat(
        a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with spans and the sanitised text."""
    docs = without(docs, *ADDED)
    spans = find_personal(docs, key, text).groupBy("mark").agg(F.first("spans").alias("spans"))
    marked = boxed(docs, key, text).select(
        "_row", F.col(text).alias("body"), F.xxhash64(key, text).alias("row_mark"))
    return marked.join(spans, F.col("row_mark") == F.col("mark")).select(
        "_row.*", "spans",
        sanitised(F.coalesce(F.col("body"), F.lit("")), F.col("spans")).alias("sanitised"))
