"""Quality rules, line first, in DataFrame functions only.

Every line of a text is judged by itself:

- punctuation: it holds no finished sentence, or more than half of its words end in a run of marks;
- navigation: a quarter of its words or more are bare separators, or it is a short menu phrase;
- boilerplate: it names licences, cookies, rights and the like, or repeats an earlier line.

Lines that fail are taken out. A document goes if the lines taken out held more than ``MAX_LOST``
per cent of its word characters, or if it fails a rule on its whole text: fewer than ``MIN_WORDS``
words, or more than ``MAX_REPEATED`` per cent of them inside repeated three-word windows.

All work is done within a row, so nothing is shuffled and no source or group of copies can be hot.
Repeated windows are found by sorting a text's windows: n log n steps and memory in proportion to
the longest text of a task.

Defined cases: a null text is empty; an empty text has no words and fails; lines without a word are
neither counted nor kept; of equal lines the first stays; rows equal in text are judged alike; null
and repeated ids pass through; an empty table gives an empty result. ``judge_documents`` reads the
key and the text only, and ``clean_documents`` returns the input's columns under their own names, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilbus.llm.columns import free_name, let

# What a word, a line and a symbol are.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# The line rules. A finished sentence is a mark, perhaps closed by quotes, before a blank or the end.
SENTENCE = r"[.!?…。！？][\x22'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"
MARKS = r"\A[!?#*$%&]{2}\z"
SEPARATORS = r"\A[|>»·•/]+\z"
MENU = (r"\A(?:home|menu|search|log ?in|log ?out|sign (?:in|up)|register|subscribe|contact us|about us|"
        r"site ?map|next|previous|back to top|read more|share this|click here)\W*\z")
BOILERPLATE = ("all rights reserved", "licensed under", "general public license",
               "permission is hereby granted", "copyright (c)", "copyright ©", "privacy policy",
               "terms of use", "terms of service", "accept cookies", "uses cookies",
               "enable javascript", "lorem ipsum")
#: A menu phrase has no more characters than this; longer lines are not tried.
MENU_CHARS = 40

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOST = 30
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_failed_lines", "lost_chars", "base_failed", "kept")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _letters(text: Column) -> Column:
    """Code points outside blanks."""
    return F.char_length(F.translate(text, BLANKS, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first ones included."""

    def windows(w: Column) -> Column:
        """Windows with their places; the two short ones at the end are equal to none."""
        n = F.size(w)
        return F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"),
                            F.sequence(F.lit(0), n - 1).alias("at"))

    def digest(z: Column) -> Column:
        return F.xxhash64(z["a"], z["b"], z["c"])

    def candidates(zipped: Column) -> Column:
        """All windows, or null if their digests differ: equal windows have equal digests."""
        return let(F.transform(zipped, digest), lambda d: F.when(
            F.size(F.array_distinct(d)) < F.size(d), zipped))

    def starts(ordered: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(ordered, j)["s"] == x["s"], F.lit(False))

        return F.sort_array(F.transform(
            F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    def named(zipped: Column) -> Column:
        return F.sort_array(F.transform(F.filter(zipped, lambda z: z["c"].isNotNull()), lambda z: F.struct(
            F.concat(z["a"], F.lit(" "), z["b"], F.lit(" "), z["c"]).alias("s"), z["at"].alias("at"))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(
            F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def count(found: Column) -> Column:
        return F.when(found.isNull(), F.lit(0).cast("long")).otherwise(
            let(let(named(found), starts), covered))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(
        let(let(windows(words), candidates), count))


def fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule of its own."""

    def noisy(words: Column) -> Column:
        ends = F.filter(words, lambda w: F.substring(F.rtrim(w, F.lit(".,;:")), -2, 2).rlike(MARKS))
        return F.size(ends) * 2 > F.size(words)

    def bare(words: Column) -> Column:
        found = F.size(F.filter(words, lambda w: w.rlike(SEPARATORS)))
        return (found >= 2) & (found * 4 >= F.size(words))

    def phrase(p: Column) -> Column:
        hit = (F.char_length(p) <= MENU_CHARS) & p.rlike(MENU)
        for words in BOILERPLATE:
            hit = hit | F.contains(p, F.lit(words))
        return hit

    plain = F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)
    # A look at the whole line spares most lines the look at each word.
    return (~line.rlike(SENTENCE) | (line.rlike("[!?#*$%&]{2}") & let(_words(line), noisy))
            | (line.rlike("[|>»·•/]") & let(_words(line), bare)) | let(plain, phrase))


def report(text: Column, max_lost: int = MAX_LOST, min_words: int = MIN_WORDS,
           max_repeated: int = MAX_REPEATED, cleaned: bool = True) -> Column:
    """struct of ``REPORT`` and, if wanted, ``cleaned``: the text without the lines that failed."""

    def lines_of(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

    def good(lines: Column) -> Column:
        """Lines, those without repeats, and those that pass, a line's word characters beside it."""
        single = F.array_distinct(lines)
        passed = F.filter(single, lambda x: ~fails(x))
        return F.struct(F.size(lines).alias("all"), F.size(single).alias("single"),
                        passed.alias("passed"))

    def counts(t: Column, words: Column, found: Column) -> Column:
        chars = F.char_length(F.array_join(words, "")).cast("long")
        held = F.when(F.size(found["passed"]) == found["all"], chars).otherwise(
            _letters(F.array_join(found["passed"], "\n")))
        repeats = repeated_words(words)
        n = F.size(words).cast("long")

        def verdict(c: Column) -> Column:
            base = (c["n"] < min_words) | (c["repeats"] * 100 > c["n"] * max_repeated)
            lost = c["chars"] - c["held"]
            values = {
                "n_words": c["n"], "word_chars": c["chars"], "n_symbols": c["symbols"],
                "n_dup_lines": (found["all"] - found["single"]).cast("long"),
                "n_repeat_words": c["repeats"], "n_lines": found["all"].cast("long"),
                "n_failed_lines": (found["all"] - F.size(found["passed"])).cast("long"),
                "lost_chars": lost, "base_failed": base,
                "kept": ~base & (lost * 100 <= c["chars"] * max_lost)}
            if cleaned:
                values["cleaned"] = F.array_join(found["passed"], "\n")
            return F.struct(*[v.alias(k) for k, v in values.items()])

        symbols = F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long")
        return let(F.struct(n.alias("n"), chars.alias("chars"), held.alias("held"),
                            repeats.alias("repeats"), symbols.alias("symbols")), verdict)

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(
        _words(t), lambda words: let(let(lines_of(t), good), lambda found: counts(t, words, found))))


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Key, ``REPORT`` and, if wanted, ``cleaned`` of every document, kept or not."""
    judged = docs.select(F.col(key), report(F.col(text), **limits).alias("_judged"))
    return judged.select(key, "_judged.*")


def clean_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Documents that stay, as the input's columns, with their failing lines taken out."""
    name = free_name(docs, "_judged")
    judged = docs.withColumn(name, report(F.col(text), **limits)).where(F.col(name)["kept"])
    return judged.select(*[
        F.col(name)["cleaned"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
