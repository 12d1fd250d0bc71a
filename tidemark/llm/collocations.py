"""Phrase collocations: phrases of a few words that stand together more often than their parts explain.

1. Texts are cut into pieces at punctuation and line ends, in lower case (A-Z); identical pieces of a language
   become one with a multiplicity, by a groupBy that pre-aggregates in each task.
2. Each task counts the words and the weighted windows of its pieces step by step. A window of the longest
   phrase's length stands for all phrases that begin with its first word, so each place is one row, not one a
   length. Rows are dealt out by their first two words to hash buckets (as many as the texts need, at least two
   for each of the session's shuffle partitions) in compressed blocks, and DuckDB counts the phrases of one bucket
   after the other out of core, within ``MEMORY`` and beyond that in a temporary folder of the task; a bucket of
   many rows is counted in several passes. Phrases below ``least`` can be neither
   candidates nor parts of one and stay behind.
3. Candidates live in homes by their hash. A home asks once for each part that any of its candidates needs:
   the requests are shuffled to the counts, the answers back to the homes, so a word that a third of all
   candidates contain is asked for once a home. A request also carries the count of the longest-standing
   longer candidate, by which shorter ones are dropped.
4. Each home scores its candidates in DuckDB (128-bit integers) and keeps the first ``top`` a language; the
   lists are merged in two rounds, groups of homes and then all.

Per language: n counts all word occurrences, a, l and r are counts of the phrase and of both sides of its
lowest-scoring cut, score is floor(1000000 a a / (l r)).

Edge cases: a null text is empty, a null language ``und``; equal rows count each; pieces without words and
phrases that cross pieces count nothing; ties of score go by a and then by the phrase's bytes; fewer
candidates than ``top`` are all given, and an empty table gives an empty result. Only the two columns named
are read, so others can't clash.
"""

from __future__ import annotations

import math
import string
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, ship, written
from .words import cut, digests

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Fixed: what separates pieces, and words within them.
PIECE_ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
#: Bytes of pieces whose n-grams a task counts at once, DuckDB's memory a task, and candidates of a home.
STEP_BYTES, MEMORY, HOME_ROWS = 4_000_000, "200MB", 100_000
#: Phrases in one compressed block at most, bytes of text for each bucket, and rows that DuckDB groups at once.
BLOCK_ROWS, BUCKET_BYTES, PASS_ROWS = 50_000, 8_000_000, 500_000
COUNTS = "lang string, size int, phrase string, f long"


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): distinct pieces, their words joined by single blanks, and how often each stands."""
    plain = F.translate(
        F.coalesce(docs[text_col].cast("string"), F.lit("")),
        string.ascii_uppercase + PIECE_ENDS + BLANKS,
        string.ascii_lowercase + "\n" * len(PIECE_ENDS) + " " * len(BLANKS),
    )
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    cut = docs.select(lang.alias("lang"), F.explode(F.split(plain, "\n", -1)).alias("piece"))
    piece = F.trim("piece")
    cut = cut.select("lang", F.when(piece.contains("  "), F.regexp_replace(piece, "  +", " ")).otherwise(piece).alias("piece"))
    return cut.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _windows(batch: pa.RecordBatch, longest: int, buckets: int) -> tuple[pa.Table, np.ndarray]:
    """(lang, head, rest, f) of the distinct words and windows of some pieces, by bucket, and the buckets' numbers.

    A window is ``longest`` words, or what the piece has left, two at least: its first two are the head, by which it
    is dealt out. It stands for all phrases that begin where it does. A single word is a head with null as rest.
    """
    words, offsets = cut(batch.column("piece"))
    coded = words.dictionary_encode()
    spelled, order = coded.dictionary, pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # 0 is no word
    spelled = pa.concat_arrays([pa.array([""], pa.large_string()), spelled.take(pa.array(order))])
    code = np.concatenate([rank[coded.indices.to_numpy(zero_copy_only=False)], np.zeros(longest, np.int64)])
    langs = batch.column("lang").dictionary_encode()
    lang_of, weights = langs.indices.to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
    word_hash, lang_hash = (digests(x.cast(pa.large_string()))[:, 0] for x in (spelled, langs.dictionary))
    piece = np.repeat(np.arange(len(batch)), np.diff(offsets))
    left = offsets[1:][piece] - np.arange(len(piece))  # words from here to the end of the piece
    tables, numbers = [], []
    for size in (1, longest):
        at = np.flatnonzero(left >= min(size, 2))
        keys = [f"w{i}" for i in range(size)]
        table = pa.table({"lang": lang_of[piece[at]], **{k: np.where(left[at] > i, code[at + i], 0) for i, k in enumerate(keys)}, "n": weights[piece[at]]})
        table = table.group_by(["lang", *keys], use_threads=False).aggregate([("n", "sum")])
        lang, *parts = (table[k].to_numpy() for k in ("lang", *keys))
        # Digests are evenly spread, so a sum of multiples deals them out evenly.
        mixed = lang_hash[lang] + sum((word_hash[x] * np.uint64(2 * i + 3) for i, x in enumerate(parts[:2])), np.zeros(len(lang), np.uint64))
        number = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        near = np.lexsort((parts[0] << 32 | parts[1] if size > 1 else parts[0], number))  # alike ones side by side compress
        spell = lambda x, near=near: spelled.take(pa.array(x[near]))
        blank = pa.scalar(" ", pa.large_string())
        head = pc.binary_join_element_wise(spell(parts[0]), spell(parts[1]), blank) if size > 1 else spell(parts[0])
        if size == 1:
            rest = pa.nulls(len(near), pa.large_string())
        elif size == 2:
            rest = pa.array([""], pa.large_string()).take(pa.array(np.zeros(len(near), np.int64)))
        else:
            rest = pc.utf8_rtrim(pc.binary_join_element_wise(*map(spell, parts[2:]), blank), characters=" ")
        f = pa.array(table["n_sum"].to_numpy()[near])
        tables.append(pa.table({"lang": langs.dictionary.take(pa.array(lang[near])), "head": head.cast(pa.string()), "rest": rest.cast(pa.string()), "f": f}))
        numbers.append(number[near])
    return pa.concat_tables(tables), np.concatenate(numbers)


def _counted(longest: int, buckets: int):
    """Tasks that count the weighted windows of their pieces, a step at a time: (bucket, data), data being compressed Arrow streams."""

    def dealt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, numbers = _windows(batch, longest, buckets)
        order = np.argsort(numbers, kind="stable")
        table, numbers = table.take(pa.array(order)).combine_chunks(), numbers[order]
        firsts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
        found, options = [], pa.ipc.IpcWriteOptions(compression="zstd")
        for first, end in zip(firsts, [*firsts[1:], len(numbers)]):
            for at in range(first, end, BLOCK_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.slice(at, min(BLOCK_ROWS, end - at)))
                found.append((int(numbers[first]), sink.getvalue().to_pybytes()))
        del table, numbers, order
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= STEP_BYTES:
                for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
                    yield from dealt(whole)
                held, size = [], 0
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield from dealt(whole)

    return run


def each(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[Iterator[pa.RecordBatch]]:
    """The rows of each value of ``key``, of a stream sorted by it."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            keys = batch.column(key).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for first, end in zip(edges, edges[1:]):
                yield int(keys[first]), batch.slice(first, end - first)

    for _, rows in groupby(parts(), key=lambda x: x[0]):
        yield (batch for _, batch in rows)


@contextmanager
def in_duckdb():
    """A DuckDB within MEMORY, on disk beyond. The folder it may spill to is the task's own and goes with it, like Spark's own spill files."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="tidemark-") as folder:
        settings = {"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}
        with duckdb.connect(":memory:", config=settings) as con:
            yield con


def _bucket_counts(longest: int, least: int, pass_rows: int = PASS_ROWS):
    """Tasks that add up the windows of their buckets and count each phrase that begins them; size 0 stands for all words of a language.

    So that what DuckDB groups fits its memory, windows are added up ``pass_rows`` at a time and phrases counted in as many passes, by hash.
    """
    schema = pa.schema([("lang", pa.string()), ("head", pa.string()), ("rest", pa.string()), ("f", pa.int64())])
    load = "INSERT INTO counted SELECT lang, head, rest, CAST(sum(f) AS BIGINT) AS f FROM arrived GROUP BY ALL"
    kinds = [(1, "head", "rest IS NULL"), (2, "head", "rest IS NOT NULL")]
    for size in range(3, longest + 1):  # of the rest, the first words
        begun = "rest" if size == longest == 3 else f"array_to_string(string_split(rest, ' ')[:{size - 2}], ' ')"
        kinds.append((size, f"head || ' ' || {begun}", f"rest <> '' AND len(string_split(rest, ' ')) >= {size - 2}"))
    count = "SELECT lang, CAST({} AS INTEGER) AS size, {} AS phrase, CAST(sum(f) AS BIGINT) AS f FROM counted WHERE {} GROUP BY ALL"
    words = count.format(0, "''", "rest IS NULL")

    def chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in rows:
            for block in batch.column("data"):
                with pa.ipc.open_stream(block.as_buffer()) as stream:
                    for x in stream:
                        if held and n + x.num_rows > pass_rows:
                            yield pa.Table.from_batches(held, schema)
                            held, n = [], 0
                        held.append(x)
                        n += x.num_rows
        if held:
            yield pa.Table.from_batches(held, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each(batches, "bucket"):
            with in_duckdb() as con:
                con.execute("CREATE TABLE counted (lang VARCHAR, head VARCHAR, rest VARCHAR, f BIGINT)")
                for chunk in chunks(rows):
                    con.register("arrived", chunk)
                    con.execute(load).fetchall()
                    con.unregister("arrived")
                passes = 1 + con.execute("SELECT count(*) FROM counted").fetchall()[0][0] // pass_rows
                for size, phrase, where in kinds:
                    for k in range(passes):
                        mine = f"{where} AND hash({phrase}) % {passes} = {k}" if passes > 1 else where
                        yield from con.sql(f"{count.format(size, phrase, mine)} HAVING sum(f) >= {int(least)}").to_arrow_reader(50_000)
                yield from con.sql(words).to_arrow_reader(50_000)

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f) of phrases of up to ``longest`` words that stand ``least`` times or more, and of size 0 the words of a part of each language."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // BUCKET_BYTES)
    counted = pieces_of(docs, text_col, lang_col).mapInArrow(_counted(longest, buckets), "bucket int, data binary")
    return counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_counts(longest, least), COUNTS)


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _requests(candidates: DataFrame) -> DataFrame:
    """(home, lang, part, longer): what each home asks for, once a part, and the largest count of its candidates around that part."""
    words, size = F.col("words"), F.col("size")
    part = lambda start, n: F.struct(
        _joined(words, start, n).alias("part"), F.when(n > 1, F.col("f")).otherwise(F.lit(0)).alias("longer")
    )
    sizes = F.sequence(F.lit(1), size - 1)
    every = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda start: part(start, n))))
    parts = candidates.select("home", "lang", F.explode(every).alias("x")).select("home", "lang", "x.part", "x.longer")
    return parts.groupBy("home", "lang", "part").agg(F.max("longer").alias("longer"))


def _scores(share: int, top: int):
    """Tasks that score the candidates of their homes and keep the first of each language."""
    schema = pa.schema([("home", pa.int64()), ("kind", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    load = "CREATE TABLE here AS SELECT * FROM arrived"  # a home at a time, which is bounded
    query = f"""
        WITH candidates AS (
            SELECT c.home, c.lang, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS w FROM here c
            LEFT JOIN here d ON d.kind = 2 AND d.home = c.home AND d.lang = c.lang AND d.phrase = c.phrase
            WHERE c.kind = 0 AND (d.f IS NULL OR 100 * CAST(d.f AS HUGEINT) < {int(share)} * CAST(c.f AS HUGEINT))),
        cuts AS (SELECT *, unnest(generate_series(1, len(w) - 1)) AS k FROM candidates),
        scored AS (
            SELECT c.home, c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
                   1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score
            FROM cuts c
            JOIN here l ON l.kind = 1 AND l.home = c.home AND l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.k], ' ')
            JOIN here r ON r.kind = 1 AND r.home = c.home AND r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY home, lang, phrase ORDER BY score, k) = 1)
        SELECT home, lang, phrase, a, l, r, CAST(score AS BIGINT) AS score FROM lowest
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {int(top)}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each(batches, "home"):
            with in_duckdb() as con:
                con.register("arrived", pa.RecordBatchReader.from_batches(schema, rows))
                con.execute(load)
                yield from con.sql(query).to_arrow_reader(50_000)

    return run


def _first(rows: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score (numbers long) of the first ``top`` phrases of each language.

    Candidates have 2 to ``longest`` words and a count of ``least`` or more; one that lies in a longer candidate
    with ``share`` percent of its count is dropped.
    """
    spark = docs.sparkSession
    counts = written(phrase_counts(docs, longest, least, text_col, lang_col), "phrase-counts")
    release(spark)
    phrases, n = counts.where("size > 0"), counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    homes = 1 + counts.where("size > 1").count() // HOME_ROWS
    home = F.pmod(F.xxhash64("lang", "phrase"), F.lit(homes))
    candidates = phrases.where("size > 1").withColumn("home", home).withColumn("words", F.split("phrase", " ", -1))

    requests = written(_requests(candidates), "phrase-requests")
    answers = requests.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    answers = answers.select("home", F.lit(1).alias("kind"), "lang", F.col("part").alias("phrase"), "f")
    longer = requests.where("longer > 0").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("longer").alias("f"))
    longer = longer.select(home.alias("home"), F.lit(2).alias("kind"), "lang", "phrase", "f")
    own = candidates.select("home", F.lit(0).alias("kind"), "lang", "phrase", "f")
    met = own.unionByName(answers).unionByName(longer).repartition("home").sortWithinPartitions("home")
    scored = met.mapInArrow(_scores(share, top), "home long, lang string, phrase string, a long, l long, r long, score long")

    groups = scored.withColumn("group", F.pmod("home", F.lit(math.isqrt(homes))))
    best = _first(_first(groups, top, "lang", "group").drop("rank"), top, "lang")
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
