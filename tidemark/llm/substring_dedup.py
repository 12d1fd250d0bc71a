"""Substring dedup: words in runs of ``window`` words that stand anywhere else too, found by difference-cover anchors.

A difference cover of a period v is a set of residues such that any two positions i and j have a common
offset d < v at which i + d and j + d are both in the cover (modulo v). So two equal windows share an
aligned anchor: a run of window - v + 1 words that starts at a cover position of both texts. Three steps:

1. Anchors, and no others, are hashed (5 of 21 positions for 35 words). Hashes found twice are candidates.
2. Around such an anchor a match extends to each window that holds the anchor; these windows are hashed at
   full length in 128 bits, and those found twice are repeated.
3. Words that repeated windows cover go.

No step pairs occurrences: a hash is counted, and each occurrence of a repeated one is marked by a window
over the sorted hashes, so a passage in a third of all texts costs as much as any other. A task that meets a
hash several times settles it there and lets one occurrence speak for it, which bounds the rows of a hash by
the number of tasks' steps. Texts are named by 128 bits of their digest: rows of one text share one
answer, whatever their ids. Answers, runs of positions, go to the texts by broadcast up to a checked size
and by a shuffled join beyond.

Words are `[^\\x20\\x09-\\x0D]+`. Edge cases: null and empty texts have no words and lose none; a text shorter
than a window loses none; equal rows and equal texts under any ids are copies of each other, so all of them
go if they hold a window; null ids are rows like others; an empty table gives an empty result; the input's
columns come back in one struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, ship, words_of, written
from .words import cut, digests

WINDOW = 35
#: Fixed: a period and a difference cover of it with the fewest residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text hashed at once, and of answers that are broadcast at most.
STEP_BYTES, BROADCAST_BYTES = 8_000_000, 32_000_000


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period, and its cover, that leaves an anchor two fifths of the window."""
    period = max(v for v in COVERS if v == 1 or 5 * (window - v + 1) >= 2 * window)
    return period, COVERS[period]


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """One 64-bit hash of two, of which the order matters."""
    first, second = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))[lane]
    x = (a ^ (a >> np.uint64(31))) * np.uint64(first) + ((b << np.uint64(23)) | (b >> np.uint64(41)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(second)
    return x ^ (x >> np.uint64(32))


def _runs_hashed(words: np.ndarray, length: int, lane: int) -> np.ndarray:
    """Hash of each run of ``length`` words, from hashes of runs of 1, 2, 4 and so on."""
    level, size, levels = words, 1, {1: words}
    while 2 * size <= length:
        level = _mixed(level[: len(level) - size], level[size:], lane) if len(level) > size else level[:0]
        size *= 2
        levels[size] = level
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    if size == length:
        return level[:n]
    rest = min(s for s in levels if s >= length - size)
    return _mixed(level[:n], levels[rest][length - rest :][:n], lane)


class Words:
    """The words of some texts one after the other, as two 64-bit hashes each."""

    def __init__(self, texts: pa.Array):
        words, self.offsets = cut(texts)
        found = digests(words)
        self.lanes = [np.ascontiguousarray(found[:, lane]) for lane in (0, 1)]
        self.counts = np.diff(self.offsets)

    def hashed(self, length: int, lane: int) -> np.ndarray:
        return _runs_hashed(self.lanes[lane], length, lane)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _settled(hashes: list[np.ndarray], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence how many there are of its hash here, and whether it speaks for them."""
    if not len(copies):
        return copies, np.zeros(0, bool)
    order = np.lexsort(hashes[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in hashes])
    counts, speaks = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    counts[order] = np.add.reduceat(copies[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    speaks[order[new]] = True
    return counts, speaks


def _distinct(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row of each text, and how many there are of it."""
    a, b = (batch.column(c).to_numpy() for c in ("name1", "name2"))
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(new)
    return batch.take(pa.array(order[first])), np.diff(np.append(first, len(order)))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Distinct texts of about STEP_BYTES each time, across Arrow batches, and their copies."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES - size, "right")))
            held.append(batch.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - before, to
            if size >= STEP_BYTES or at < len(ends):
                yield _distinct(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
    if held:
        yield _distinct(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _spread(speaks: np.ndarray, by: np.ndarray) -> np.ndarray:
    """0 for what speaks for its hash; settled occurrences get other lanes, so that a hot hash isn't one group."""
    return np.where(speaks, 0, 1 + (by.astype(np.uint64) & np.uint64(0x3FFFFFFF))).astype(np.int32)


def _anchors(window: int):
    """Tasks of step 1: (hash, name1, place, copies, lane), place counting cover positions of the text."""
    period, residues = cover(window)
    length, residues = window - period + 1, np.array(residues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, copies in _steps(batches):
            words = Words(texts.column("text"))
            usable = np.maximum(words.counts - window + period, 0) * (words.counts >= window)  # places for anchors
            places = usable // period * len(residues) + np.searchsorted(residues, usable % period)
            text = np.repeat(np.arange(len(copies)), places)
            place = _ranges(np.zeros(len(places), np.int64), places)
            at = words.offsets[text] + place // len(residues) * period + residues[place % len(residues)]
            hashed = words.hashed(length, 0)[at] if len(at) else np.zeros(0, np.uint64)
            counts, speaks = _settled([hashed], copies[text])
            name = texts.column("name1").to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (hashed.view(np.int64), name, place.astype(np.int32), counts, _spread(speaks, name))],
                ["hash", "name1", "place", "copies", "lane"],
            )

    return run


def _windows(window: int):
    """Tasks of step 2: (hash1, hash2, name1, name2, place, copies, lane) of the windows that hold a candidate."""
    period, residues = cover(window)
    k, reach = len(residues), period - 1
    residues = np.array(residues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, copies in _steps(batches):
            words = Words(texts.column("text"))
            runs = texts.column("runs")
            each, flat = np.diff(runs.offsets.to_numpy()), runs.flatten()
            text = np.repeat(np.arange(len(copies)), each)
            first, last = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            first, last = (x // k * period + residues[x % k] for x in (first, last))
            # Cover positions are less than a window's reach apart, so a run of anchors is a run of windows.
            first, last = np.maximum(first - reach, 0), np.minimum(last, words.counts[text] - window)
            mark = np.zeros(int(words.offsets[-1]) + 1, np.int32)
            some = last >= first
            np.add.at(mark, words.offsets[text[some]] + first[some], 1)
            np.add.at(mark, words.offsets[text[some]] + last[some] + 1, -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            text = np.searchsorted(words.offsets, at, "right") - 1
            hashes = [words.hashed(window, lane)[at] for lane in (0, 1)] if len(at) else [np.zeros(0, np.uint64)] * 2
            counts, speaks = _settled(hashes, copies[text])
            names = [texts.column(c).to_numpy()[text] for c in ("name1", "name2")]
            place = (at - words.offsets[text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*(h.view(np.int64) for h in hashes), *names, place, counts, _spread(speaks, names[0]))],
                ["hash1", "hash2", "name1", "name2", "place", "copies", "lane"],
            )

    return run


def _runs(places: Column) -> Column:
    """Runs of consecutive numbers (first, last) in sorted places."""
    firsts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    lasts = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _repeated(found: DataFrame, by: list[str], names: list[str], table: str) -> DataFrame:
    """For each text the runs of places whose hash stands twice or more, as a table."""
    everywhere = F.sum("copies").over(Window.partitionBy(*by, "lane"))
    twice = found.withColumn("copies", everywhere).where("copies > 1")
    sets = twice.groupBy(*names).agg(F.array_sort(F.collect_set("place")).alias("places"))  # of one text: as long as it is
    return written(sets.select(*names, _runs(F.col("places")).alias("runs")), table)


def _sent(answers: DataFrame) -> DataFrame:
    """Answers as a broadcast side up to BROADCAST_BYTES; beyond, as they are, for a shuffled join."""
    size = answers.agg((F.count("*") * 64 + F.coalesce(F.sum(F.size("runs")), F.lit(0)) * 24).alias("bytes")).first()["bytes"]
    return F.broadcast(answers) if size <= BROADCAST_BYTES else answers


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """row (the input's columns), n_words, n_removed (int) and kept (the words that stay, with single blanks) of each document."""
    spark = docs.sparkSession
    ship(spark)
    text = docs[text_col].cast("string")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    name1, name2 = F.xxhash64(digest).alias("name1"), F.xxhash64(F.lit(1), digest).alias("name2")
    texts = docs.select(name1, name2, F.coalesce(text, F.lit("")).alias("text")).where(F.length("text") >= 2 * window - 1)

    anchors = texts.mapInArrow(_anchors(window), "hash long, name1 long, place int, copies long, lane int")
    candidates = _repeated(anchors, ["hash"], ["name1"], "anchors")
    around = texts.join(_sent(candidates), "name1").select("name1", "name2", "text", "runs")
    windows = around.mapInArrow(_windows(window), "hash1 long, hash2 long, name1 long, name2 long, place int, copies long, lane int")
    repeated = _repeated(windows, ["hash1", "hash2"], ["name1", "name2"], "windows")
    discard(candidates)
    release(spark)

    whole = docs.select(F.struct("*").alias("row"), words_of(text).alias("words"), name1, name2)
    both = whole.join(_sent(repeated), ["name1", "name2"], "left")
    runs = F.coalesce(F.col("runs"), F.array().cast("array<struct<first:int,last:int>>"))
    # What stays: from after one covered stretch to before the next; stretches of windows may overlap.
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + window))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size("words")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("words"), a + 1, F.greatest(b - a, F.lit(0)))))
    out = both.select("row", "words", F.when(F.col("runs").isNull(), F.col("words")).otherwise(kept).alias("kept"))
    return out.select("row", F.size("words").alias("n_words"), (F.size("words") - F.size("kept")).alias("n_removed"), F.array_join("kept", " ").alias("kept"))
