"""Approximate nearest neighbours by additive quantisation, with exact reranking.

Vectors are scaled to length 1. Each is coded as the sum of one codeword from each of ``books`` codebooks of
full dimension, fitted one on the residuals of those before, on a bounded sample; a beam search keeps the
``beam`` best partial sums while it codes. The norm of the sum is stored with the code. A query is scored
against codes by lookup tables (its products with all codewords) divided by the stored norms; the
``rerank`` best of each block of vectors are then scored exactly in double precision, on the vectors as
given, and the best of all blocks are the answer.

The index holds every row. Queries are a table too: workers read it from the shared folder, a block at a
time, for each block of the index; nothing grows in memory with either.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor
does one of another dimension than the most frequent one; components of any finite size count; equal vectors tie exactly, ties go to smaller
ids; rows that share an id are never each other's answers; fewer candidates than k are all returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written


@dataclass(frozen=True)
class Settings:
    """``sample``: vectors, on average, that codebooks are fitted on."""

    books: int = 20
    words: int = 256
    beam: int = 4
    sample: int = 8192
    iterations: int = 6
    rerank: int = 512
    block: int = 65_536
    query_block: int = 256


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x words x dimension, float32

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and norms of the sums, for rows of unit length."""
        books, words, _ = self.words.shape
        flat = self.words.reshape(books * words, -1)
        gram = flat @ flat.T
        own = np.einsum("ij,ij->i", flat, flat)
        product = x @ flat.T
        n = len(x)
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)  # squared distance less the vector's square
        for b in range(books):
            at = slice(b * words, (b + 1) * words)
            # |x - s - w|^2 - |x - s|^2 = |w|^2 - 2 x.w + 2 s.w for the partial sum s.
            step = own[at] - 2 * product[:, None, at]
            for c in range(b):
                step = step + 2 * gram[codes[:, :, c] + c * words, at]
            total = (cost[:, :, None] + step).reshape(n, -1)
            keep = min(beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = np.take_along_axis(total, best, axis=1)
            before = np.take_along_axis(codes, (best // words)[:, :, None], axis=1) if b else np.zeros((n, keep, 0), np.int64)
            codes = np.concatenate([before, (best % words)[:, :, None]], axis=2)
        codes = np.take_along_axis(codes, cost.argmin(axis=1)[:, None, None], axis=1)[:, 0]
        total = sum(self.words[b, codes[:, b]] for b in range(books))
        return codes.astype(np.uint8), np.sqrt(np.einsum("ij,ij->i", total, total)).astype(np.float32)


def fit_codebooks(x: np.ndarray, settings: Settings) -> Codebooks:
    """k-means on the residuals, book after book. ``x``: rows of unit length, in an order that is always the same."""
    random = np.random.default_rng(7)
    rest, books = x.astype(np.float32), []
    for _ in range(settings.books):
        centres = rest[random.choice(len(rest), settings.words, replace=len(rest) < settings.words)].copy()
        for _ in range(settings.iterations):
            near = (rest @ centres.T * 2 - np.einsum("ij,ij->i", centres, centres)).argmax(axis=1)
            sizes = np.bincount(near, minlength=settings.words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        near = (rest @ centres.T * 2 - np.einsum("ij,ij->i", centres, centres)).argmax(axis=1)
        books.append(centres)
        rest = rest - centres[near]
    return Codebooks(np.stack(books).astype(np.float32))


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part, but for their dimension."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return rows.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimension)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1: exact, and no square over- or underflows."""
    power = np.frexp(np.abs(x).max(axis=1))[1] if len(x) else np.zeros(0, np.int64)
    return np.ldexp(x, -power[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def build_index(df: DataFrame, id_col: str, vector_col: str, settings: Settings) -> tuple[DataFrame | None, Codebooks | None, int]:
    """The index (vec_id, vector, code, norm) as a table, its codebooks and the dimension; None without vectors."""
    ship(df.sparkSession)
    rows = valid_vectors(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None, None, 0
    dimension, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("vector") == dimension)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000
    some = rows.where(part < settings.sample / n) if n > settings.sample else rows
    some = some.orderBy("vec_id", "vector").toArrow()  # about ``sample`` rows
    if not len(some):
        some = rows.orderBy("vec_id").limit(settings.sample).toArrow()
    books = fit_codebooks(_unit(_matrix(some["vector"].combine_chunks(), dimension)), settings)
    known = df.sparkSession.sparkContext.broadcast(books)  # books x words x dimension floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                codes, norms = known.value.encode(_unit(_matrix(batch.column("vector"), dimension)).astype(np.float32), settings.beam)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)],
                    ["vec_id", "vector", "code", "norm"],
                )

    coded = rows.mapInArrow(run, "vec_id bigint, vector array<double>, code binary, norm float")
    return written(coded, "ann-index"), books, dimension


def _query_blocks(files: list[str], dimension: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(size, columns=["vec_id", "vector"]):
                if batch.num_rows:
                    yield batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), dimension)


def search(
    df: DataFrame, query_filter: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    settings: Settings | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all rows for each row with ``query_filter`` (SQL on vec_id)."""
    settings = settings or Settings()
    spark = df.sparkSession
    index, books, dimension = build_index(df, id_col, vector_col, settings)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = written(index.where(query_filter).select("vec_id", "vector").distinct(), "ann-queries")
    files = sorted(queries.inputFiles())
    known = spark.sparkContext.broadcast(books)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        ids, vectors = table["vec_id"].to_numpy(), _scaled(_matrix(table["vector"].chunk(0), dimension))
        codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        norms, lengths = table["norm"].to_numpy(), np.sqrt((vectors * vectors).sum(axis=1))
        words = known.value.words
        for query_ids, asked in _query_blocks(files, dimension, settings.query_block):
            tables = np.einsum("qd,bwd->bqw", _unit(asked).astype(np.float32), words)
            asked, out = _scaled(asked), []
            for first in range(0, len(asked), 16):
                some = slice(first, min(len(asked), first + 16))
                scores = np.zeros((some.stop - some.start, len(ids)), np.float32)
                for b in range(words.shape[0]):
                    scores += tables[b, some][:, codes[:, b]]
                scores /= np.maximum(norms, 1e-12)
                for i, row in enumerate(scores):
                    q = first + i
                    own = np.searchsorted(ids, [query_ids[q], query_ids[q] + 1])
                    row[own[0] : own[1]] = -np.inf
                    keep = min(settings.rerank, len(ids))
                    border = np.partition(row, len(row) - keep)[len(row) - keep]
                    sure = np.flatnonzero(row > border)
                    near = np.concatenate([sure, np.flatnonzero(row == border)[: keep - len(sure)]])  # ties: smaller ids
                    near = near[row[near] > -np.inf]
                    size = np.sqrt((asked[q] * asked[q]).sum())
                    exact = (vectors[near] * asked[q]).sum(axis=1) / (lengths[near] * size)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out += [(int(query_ids[q]), int(ids[near[j]]), float(exact[j])) for j in best]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= settings.block:
                yield from block(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from block(pa.Table.from_batches(held))

    found = index.mapInArrow(run, "query_id bigint, vec_id bigint, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
