"""Line dedup: later occurrences of repeated three-line windows go, corpus-wide, native DataFrame operations only.

Every run of ``window`` consecutive lines is hashed. A hash found more than once marks all of its
occurrences but the first in (doc_id, text hash, position) order; the positions that marked windows
cover are merged, and those lines are removed. So each removed line has an equal line that stays:
the first occurrence of its window is earlier, and going back ends at a line that is kept.

Lines are the ``\\n``-separated pieces of a text. Lines without a word (blank) are not counted in a
window, and go when a removed window spans them. A text with fewer such lines than a window has one
window, its whole line sequence, so that short copies are found like long ones. A line of more than
``long_line`` words, a whole passage, is a window by itself too, since the lines around it may differ.
Blanks at the end of a line don't count when lines are compared.

Edge cases: null or empty text is returned as it is and counts 0 removed; rows equal in id and text
are one document given twice and get the same result; null ids come first in the order; an empty
table gives an empty result; other columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, written

WINDOW, LONG_LINE = 3, 50
BROADCAST_BYTES = 32_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(keys: DataFrame, window: int, long_line: int) -> DataFrame:
    """(doc_id, text_hash, first_line, last_line, h1, h2) of each window of each document."""
    bare = lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+$", "")
    full = keys.select(
        "doc_id",
        "text_hash",
        F.filter(
            F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), bare(x).alias("line"))),
            lambda x: x["line"] != "",
        ).alias("full"),
    ).where(F.size("full") > 0)
    full = full.withColumn("width", F.least(F.size("full"), F.lit(window)))

    def hashed(part: Column, first: Column, last: Column) -> Column:
        # 128 bits: two 64-bit hashes of the same lines, the second chained from another seed.
        return F.struct(
            first.alias("first_line"),
            last.alias("last_line"),
            F.xxhash64(part).alias("h1"),
            F.xxhash64(F.lit(window), part, F.length(part)).alias("h2"),
        )

    def of_lines(i: Column) -> Column:
        part = F.array_join(F.slice(F.col("full.line"), i + 1, F.col("width")), "\n")
        return hashed(part, F.get("full.at", i), F.get("full.at", i + F.col("width") - 1))

    def is_long(x: Column) -> Column:
        words = F.regexp_count(x["line"], F.lit(r"[^\x20\x09-\x0D]+"))
        return (F.char_length(x["line"]) > 2 * long_line) & (words > long_line)

    starts = F.sequence(F.lit(0), F.size("full") - F.col("width"))
    windows = F.transform(starts, of_lines)
    long_ones = F.transform(F.filter("full", is_long), lambda x: hashed(x["line"], x["at"], x["at"]))
    any_long = (F.col("width") > 1) & F.exists("full", is_long)
    windows = F.when(any_long, F.concat(windows, long_ones)).otherwise(windows)
    return full.select("doc_id", "text_hash", F.explode(windows).alias("w")).select(
        "doc_id", "text_hash", "w.*"
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_line: int = LONG_LINE
) -> DataFrame:
    """``docs`` with its text column cleaned, and ``n_lines`` and ``n_removed`` (int) added (with underscores if ``docs`` has them)."""
    text = docs[text_col].cast("string")
    keys = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    seen = written(_windows(keys, window, long_line), "windows")  # hashes and places, cut and hashed once
    place = F.struct("doc_id", "text_hash", "first_line")
    # Aggregated in each task first: a window that a third of the corpus holds is one row a task here.
    repeated = (
        seen.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    # A sort-merge join whose hot windows adaptive execution can split.
    later = seen.join(repeated, ["h1", "h2"]).where(~F.col("first").eqNullSafe(place))
    covered = later.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.flatten(F.collect_list(F.sequence("first_line", "last_line"))).alias("_covered")
    )
    covered = written(covered, "covered-lines")
    discard(seen)
    # Up to BROADCAST_BYTES the lines to remove go to the texts; beyond, texts and lines meet in a shuffled join.
    size = covered.agg((F.count("*") * 64 + F.coalesce(F.sum(F.size("_covered")), F.lit(0)) * 4).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:
        covered = F.broadcast(covered)
    whole = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), text.alias("text"))
    both = whole.join(
        covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left"
    ).withColumn("lines", _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("_covered"))
    both = both.withColumn("kept", F.when(F.col("_covered").isNotNull(), kept))
    cleaned = F.when(
        F.col("kept").isNotNull(),
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"),
    ).otherwise(F.col("text"))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines"))
    removed = F.when(F.col("kept").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0)
    others = [F.col("row").getField(c).alias(c) if c != text_col else cleaned.alias(c) for c in docs.columns]
    return both.select(*others, n_lines.alias(free_name("n_lines", docs.columns)), removed.alias(free_name("n_removed", docs.columns)))
