"""Quality rules by distribution divergence, native DataFrame operations only.

Two histograms describe a text: the classes of its characters (letters, capitals, digits, blanks,
symbols, other marks) and its share of each common word of its language. The references are the
same histograms over all documents of the declared language, so nothing is listed by hand. A text
fails where the Jensen-Shannon distance (base 2, so 0 to 1) from a reference is over a limit. What
sampling alone adds to a divergence, on average, is taken off first: (bins - 1) / (8 ln 2) times
1 / words of the text + 1 / documents of the reference. Texts of fewer than ``min_words`` words are
not judged. Base counts and base rules (too few words, too much repetition) come first.

Texts are read twice: for the word counts of each language, then for each document's counts and hits
of common words, which go into a table. Class references and verdicts come from that table.

Edge cases: a null or empty text counts 0 everywhere and fails the base rules; a null language is
held against the reference over all languages; a language whose texts have no word has no reference
and judges nothing; repeated rows are judged each for itself; an empty table gives an empty result;
columns of the input other than the two named are kept and not looked at, but one that has the name
of a result is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, discard, written

#: Fixed by the contract: the symbol characters, the base rules' limits.
SYMBOLS = "#*$%&|<>"
BASE_WORDS, BASE_REPEAT = 50, 50
#: The character classes of the histogram, in its order.
CLASSES = ("letters", "capitals", "digits", "blanks", "symbols", "marks")
#: What ``base_counts`` and ``quality_rules`` add.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICTS = ("class_distance", "word_distance", "kept")
#: Languages whose common words are looked up in one set in the plan; words of others are looked up row by
#: row, with the same result. Buckets that a language's words are ranked in before they meet.
LISTED, RANKED = 1000, 16


@dataclass(frozen=True)
class Limits:
    """Limits of the divergence rules; each language's ``common_words`` largest make its word histogram."""

    common_words: int = 32
    class_distance: float = 0.28
    word_distance: float = 0.30
    min_words: int = BASE_WORDS


#: Fixed: the insides of bracket expressions for capitals (Latin, Greek, Cyrillic) and for marks with symbols.
CAPITALS = r"A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
MARKS = r"!-/:-@\[-`{-~¡-¿‐-⁞、-〃"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, inside: str) -> Column:
    """Characters of ``text`` in the bracket expression of this inside: what goes when they go.

    The expression isn't negated: Java matches a negated one of several ranges some twenty times slower.
    """
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{inside}]+", ""))).cast("long")


def _flat(text: Column) -> Column:
    """``text`` with a blank for every character that separates words."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(flat: Column) -> Column:
    return F.array_remove(F.split(flat, " ", -1), "")


def _shifted(f: str, x: Column, by: Column) -> Column:
    return F.call_function(f, x, by)


def _repeat_words(words: Column) -> Column:
    """Words in a 3-word window that is there twice or more.

    Most texts have no two windows of one hash, which a set of the hashes shows. In the others a window's hash
    and its place make one long, the place in the low bits, so one sort of primitives brings equal windows
    together; the words themselves are then compared with a neighbour's.
    """
    n = F.size(words) - 2

    def covered(windows: Column) -> Column:
        bits = F.length(F.bin(F.size(windows).cast("long")))
        low = _shifted("shiftleft", F.lit(1).cast("long"), bits) - 1
        placed = F.transform(windows, lambda h, i: _shifted("shiftleft", h, bits).bitwiseOR(i.cast("long")))
        place = lambda x: x.bitwiseAND(low).cast("int")

        def same(x: Column, y: Column) -> Column:
            equal = _shifted("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
            for k in range(3):
                equal = equal & (F.get(words, place(x) + k) == F.get(words, place(y) + k))
            return F.coalesce(equal, F.lit(False))

        twice = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        places = _let(F.sort_array(placed), lambda s: F.sort_array(F.transform(twice(s), place)))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return _let(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda s, x: s + x))

    hashes = lambda h: F.zip_with(
        F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, n), lambda a, b: F.xxhash64(a, b)
    )
    windows = _let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    found = _let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < 2, F.lit(0)).otherwise(found)


def _dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    full = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    found = lambda x: F.when(
        F.size(x) > F.size(F.array_distinct(x)), _let(F.filter(x, full), lambda y: F.size(y) - F.size(F.array_distinct(y)))
    ).otherwise(F.lit(0))
    return _let(F.split(text, "\n", -1), found)


def _base(text: Column, words: Column, flat: Column) -> Column:
    """A text's base counts and character classes as a struct."""
    n_words, n_repeat = F.size(words).cast("long"), _repeat_words(words).cast("long")
    solid = F.char_length(F.replace(flat, F.lit(" "), F.lit(""))).cast("long")
    counted = F.struct(
        n_words.alias("n_words"), solid.alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
        F.char_length(text).cast("long").alias("all"), _count(text, CAPITALS).alias("capitals"),
        _count(text, "0-9").alias("digits"), _count(text, MARKS).alias("marks"),
    )

    def finished(c: Column) -> Column:
        failed = (c["n_words"] < BASE_WORDS) | (100 * c["n_repeat_words"] > BASE_REPEAT * c["n_words"])
        letters = c["word_chars"] - c["capitals"] - c["digits"] - c["marks"]
        classes = F.array(
            letters, c["capitals"], c["digits"], c["all"] - c["word_chars"], c["n_symbols"], c["marks"] - c["n_symbols"]
        )
        return F.struct(*(c[k].alias(k) for k in COUNTS[:-1]), failed.alias("base_failed"), classes.alias("classes"))

    return _let(counted, finished)


def _counted(text: Column, more: Callable[[Column, Column], dict[str, Column]] | None = None) -> Column:
    """A struct of ``base`` and what ``more`` makes of the flat text and its words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    rest = lambda flat, words: [x.alias(k) for k, x in (more(flat, words) if more else {}).items()]
    body = lambda t: _let(_words(t["flat"]), lambda w: F.struct(_base(t["text"], w, t["flat"]).alias("base"), *rest(t["flat"], w)))
    return _let(F.struct(text.alias("text"), _flat(text).alias("flat")), body)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    both = docs.select(F.struct("*").alias("row"), _counted(docs[text_col])["base"].alias("base"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in COUNTS]
    return both.select(*kept, *(F.col("base")[k].alias(k) for k in COUNTS))


def common_words(rows: DataFrame, most: int) -> DataFrame:
    """(lang, common, common_q): the ``most`` most frequent words of each language of ``rows`` (lang, text) and their
    shares; a null language has those of all rows."""
    # Summed in each task before the shuffle: rows are distinct words, whatever language or source is hot.
    text = F.lower(_flat(F.coalesce("text", F.lit(""))))
    words = rows.select("lang", F.explode(F.split(text, " ", -1)).alias("word")).where("word <> ''")
    counts = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    own = counts.where("lang IS NOT NULL")
    if not counts.where("lang IS NULL").isEmpty():
        pooled = counts.groupBy("word").agg(F.sum("n").alias("n"))
        own = own.unionByName(pooled.select(F.lit(None).cast("string").alias("lang"), "word", "n"))
    totals = own.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("total"))
    # Ranked in buckets first, so that no language's words meet in one task.
    for keys in (["lang", "bucket"], ["lang"]):
        own = own.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(RANKED)))
        top = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
        own = own.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most)
    entry = F.struct("rank", "word", (F.col("n") / F.col("total")).alias("q"))
    found = own.join(totals, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("lang").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    found = written(found.select("lang", F.col("c.word").alias("common"), F.col("c.q").alias("common_q")), "common-words")
    discard(counts)
    return found


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a row a language, to be broadcast if they are few."""
    return F.broadcast(rows) if len(rows.select("lang").limit(LISTED + 1).collect()) <= LISTED else rows


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def _distance(p: Column, q: Column, noise: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of one order; ``noise`` is taken off the divergence."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(_sum(both) - noise, F.lit(0.0)))


def _whole(p: Column) -> Column:
    """A histogram with the rest as its last entry."""
    return _let(p, lambda x: F.concat(x, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - _sum(x)))))


def quality_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits | None = None, carry: list[str] | None = None
) -> DataFrame:
    """``docs`` with the base counts, base_failed, class_distance, word_distance (null: not judged) and kept.

    ``carry`` names the columns of ``docs`` to return, all by default; a result whose name is among them gets underscores.
    """
    limits = limits or Limits()
    carry = list(docs.columns if carry is None else carry)
    lang = docs[lang_col].cast("string")
    refs = common_words(docs.select(lang.alias("lang"), docs[text_col].cast("string").alias("text")), limits.common_words)
    few = _few(refs)
    listed = refs.where("lang IS NOT NULL").orderBy("lang").limit(LISTED).unionByName(refs.where("lang IS NULL")).collect()
    names = [r["lang"] for r in listed if r["lang"] is not None]
    known = sorted({w for r in listed for w in r["common"]})  # at most LISTED + 1 languages' common words

    def hits(flat: Column, words: Column) -> dict[str, Column]:
        lower = _words(F.lower(flat))
        one_set = F.filter(lower, lambda w: w.isin(known)) if known else F.array().cast("array<string>")
        found = F.when(F.col("_lang").isNull() | F.col("_lang").isin(names), one_set).otherwise(F.filter(lower, lambda w: F.array_contains("common", w)))
        counts = _let(found, lambda x: F.transform("common", lambda w: F.size(x) - F.size(F.array_remove(x, w))))
        return {"hits": F.when((F.size(words) >= limits.min_words) & F.col("common").isNotNull(), counts)}

    row = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(carry)), F.lit(0).alias("_"))
    whole = docs.select(row.alias("row"), lang.alias("_lang"), docs[text_col].alias("_text"))
    both = whole.join(few.select("lang", "common"), F.col("_lang").eqNullSafe(F.col("lang")), "left")
    both = both.select("row", F.col("_lang").alias("lang"), _counted(F.col("_text"), hits).alias("q"))
    table = written(both.select("row", "lang", "q.base", "q.hits"), "quality-counts")
    parts = [F.sum(F.col("base.classes")[i]).cast("double").alias(k) for i, k in enumerate(CLASSES)]
    sized = F.sum((F.col("base.n_words") > 0).cast("long")).alias("n_docs")
    sums = written(table.groupBy("lang").agg(*parts, sized), "class-counts")
    pooled = sums.agg(*(F.sum(k).alias(k) for k in (*CLASSES, "n_docs"))).withColumn("lang", F.lit(None).cast("string"))
    sums = sums.where("lang IS NOT NULL").unionByName(pooled)
    chars = sum((F.col(k) for k in CLASSES), F.lit(0.0))
    of_lang = sums.select(F.col("lang").alias("_of"), F.array(*(F.col(k) / chars for k in CLASSES)).alias("class_q"), "n_docs")
    of_lang = refs.join(of_lang, F.col("lang").eqNullSafe(F.col("_of"))).select("lang", "class_q", "n_docs", "common_q")
    of_lang = _few(written(of_lang, "references")).withColumnRenamed("lang", "_of")
    table = table.join(of_lang, F.col("lang").eqNullSafe(F.col("_of")), "left")

    n_words, base = F.col("base.n_words"), F.col("base")
    once = (1 / n_words + 1 / F.col("n_docs")) / (8 * math.log(2))
    class_p = _let(F.col("base.classes").cast("array<double>"), lambda c: F.transform(c, lambda x: x / _sum(c)))
    word_p = _whole(F.transform("hits", lambda n: n / n_words))
    judged = F.col("hits").isNotNull() & F.col("_of").isNotNull()
    by_class = F.when(judged, _distance(class_p, F.col("class_q"), (len(CLASSES) - 1) * once))
    by_word = F.when(judged, _distance(word_p, _whole(F.col("common_q")), F.size("common_q") * once))

    def verdict(d: Column) -> Column:
        over = (d["class_distance"] > limits.class_distance) | (d["word_distance"] > limits.word_distance)
        return F.struct(*(d[k].alias(k) for k in VERDICTS[:2]), (~d["base_failed"] & ~F.coalesce(over, F.lit(False))).alias("kept"))

    distances = F.struct(by_class.alias("class_distance"), by_word.alias("word_distance"), base["base_failed"].alias("base_failed"))
    table = table.select("row", "base", _let(distances, verdict).alias("v"))
    return table.select(
        *(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry)),
        *(F.col("base").getField(k).alias(free_name(k, carry)) for k in COUNTS), *(F.col("v").getField(k).alias(free_name(k, carry)) for k in VERDICTS),
    )
