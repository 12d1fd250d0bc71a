"""The similarity join: the k best items for each query, by cosine, with ties to the earlier item.

Vectors meet as matrices in Arrow batches. The item side is collected and broadcast only up to
``BROADCAST_BYTES``; beyond that it is a table in the shared folder that workers stream through, block by
block, once for each ``ASKED`` queries of a task. Either way each task keeps k rows a query, and no pair
leaves a task unless it is among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import ship, written

BROADCAST_BYTES = 64_000_000
BLOCK = 8192
#: Queries that a task holds at once while it goes through the items.
ASKED = 16_384
#: Decimals to which scores of real-valued vectors are rounded before they are ranked.
DECIMALS = 9
#: Items and bytes of a step of sums, rows of a query up to which sums are made, and the ratio of norms of queries that share a scale.
SUMMED, SUM_BYTES, MOST_ROWS, ALIKE = 4096, 1 << 21, 96, 1.25
#: A bucket has a row for counts of 1, 2 and 4.
LEVELS = 3
#: Pairs of vectors that are taken out of matrices at once.
SINGLE = 512


def _matrix(column, dim: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if dim is not None:
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        return np.bincount(row * dim + column.flatten().to_numpy(), minlength=len(column) * dim).reshape(-1, dim).astype(np.float64)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _scaled(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The vectors by their norms, in single precision; zero ones as they are."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _slack(a: np.ndarray, b: np.ndarray, decimals: int | None) -> float:
    """More than a product of two rows in single precision can differ from the rounded score."""
    most = float(_norms(a).max(initial=0)) * float(_norms(b).max(initial=0))
    return 2e-7 * (a.shape[1] + 8) * (most + 1) + (0 if decimals is None else 10.0**-decimals)


def streamed(rows: DataFrame, block: int, name: str = "items") -> Callable[[], Iterator[pa.Table]]:
    """A function for workers that goes through the rows, ``block`` at a time, from a table in the shared folder."""
    files = sorted(written(rows, name).inputFiles())

    def opened() -> Iterator[pa.Table]:
        for uri in files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(block):
                    yield pa.Table.from_batches([batch])

    return opened


def _item_blocks(items: DataFrame, dim: int | None, normalise: bool) -> Callable[[], Iterator[tuple]]:
    """A function for workers that yields (seq, ns, matrix, norms) of the items, block by block."""
    spark, kind = items.sparkSession, "array<double>" if dim is None else "array<int>"
    items = items.select(F.col("seq").cast("long").alias("seq"), F.col("ns").cast("string").alias("ns"), F.col("vector").cast(kind).alias("vector"))
    if dim is not None:
        items = written(items, "item-buckets")  # texts are cut into tokens once, for the size and for the rows
    shape = items.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()
    small = shape["n"] * (8 if dim is None else 4) <= BROADCAST_BYTES
    table = spark.sparkContext.broadcast(items.orderBy("seq").toArrow()) if small else None
    opened = None if small else streamed(items.sortWithinPartitions("seq"), BLOCK)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for t in ([table.value] if len(table.value) else []) if table is not None else opened():
            for first in range(0, len(t), BLOCK):
                some = t.slice(first, BLOCK)
                x = _matrix(some["vector"], dim)
                yield some["seq"].to_numpy(), np.array(some["ns"].to_pylist(), object), x, _norms(x) if normalise else np.ones(len(x))

    return blocks


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class _Best:
    """The k best (score, seq) of each query so far; -inf where there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.seq = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, rows: slice | np.ndarray, score: np.ndarray, seq: np.ndarray) -> None:
        """Scores of some queries with a block of items in seq order; what may not be found is -inf. ``seq`` is one for all queries or a row each."""
        k, old = self.k, self.score[rows]
        least = old[:, -1:]  # the worst of k so far: less can't come in
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k, None])
        tied = score == least
        tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= k  # items are in seq order: of equal ones the first k do
        i, j = np.nonzero(((score > least) | tied) & (score > -np.inf))
        if len(i):
            self.merge(rows, i, score[i, j], seq[j] if seq.ndim == 1 else seq[i, j])

    def merge(self, rows: slice | np.ndarray, i: np.ndarray, score: np.ndarray, seq: np.ndarray) -> None:
        """Single scores: of row i of some queries with items."""
        k, old, own = self.k, self.score[rows], self.seq[rows]
        row = np.concatenate([np.repeat(np.arange(len(old)), k), i])
        value, place = np.concatenate([old.ravel(), score]), np.concatenate([own.ravel(), seq])
        order = np.lexsort((place, -value, row))
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        self.score[rows], self.seq[rows] = value[order][kept].reshape(-1, k), place[order][kept].reshape(-1, k)


def _rows_of(counts: np.ndarray) -> np.ndarray:
    """How often a query of these counts takes the rows of its buckets: one row for a bit of a count."""
    whole = counts.astype(np.int64)
    return np.concatenate([whole >> b if b == LEVELS - 1 else (whole >> b) & 1 for b in range(LEVELS)], axis=1)


class _Rows:
    """The rows that sums of some queries are made of (a blank one where there are no more) and the scale of the sums."""

    def __init__(self, counts: np.ndarray, scale: float):
        times = _rows_of(counts)
        self.n = times.sum(axis=1)
        self.at = np.full((len(times), int(self.n.max(initial=1))), times.shape[1], np.intp)
        i, row = np.nonzero(times)
        self.at[np.arange(self.at.shape[1]) < self.n[:, None]] = np.repeat(row, times[i, row])
        self.scale = scale

    def only(self, queries: np.ndarray) -> _Rows:
        some = object.__new__(_Rows)
        some.n, some.at, some.scale = self.n[queries], self.at[queries], self.scale
        return some


class _Sums:
    """Items of unit length as whole numbers of a byte, rows of buckets: the sum of a query's rows is near its product with each item.

    A query has few tokens, so that their rows cost less than a product over all buckets. Each row adds half a unit
    to the error at most, and scales keep sums under 256.
    """

    def __init__(self, less: np.ndarray):
        self.parts = [np.ascontiguousarray(less[a : a + SUMMED].T) for a in range(0, len(less), SUMMED)]
        self.scaled: dict[float, list[np.ndarray]] = {}

    def table(self, scale: float) -> list[np.ndarray]:
        if scale not in self.scaled:
            whole = lambda x, level: np.minimum(x * np.float32(scale * 2**level) + np.float32(0.5), np.float32(255)).astype(np.uint8)
            blank = lambda x: np.zeros((1, x.shape[1]), np.uint8)
            self.scaled[scale] = [np.concatenate([*(whole(x, level) for level in range(LEVELS)), blank(x)]) for x in self.parts]
        return self.scaled[scale]

    def reaching(self, asked: _Rows, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs whose product, of the query's counts with the item, may be ``least``; and of some others."""
        need = np.clip(np.ceil(asked.scale * least - asked.n / 2 - 0.01), 0, 255).astype(np.uint8)
        found, space = [], np.empty(0, np.uint8)
        for k, rows in enumerate(self.table(asked.scale)):
            first = 0
            while first < len(need):
                width = max(1, int(asked.n[first]))
                step = max(1, SUM_BYTES // (width * rows.shape[1]))
                width = max(1, int(asked.n[first : first + step].max()))
                at = asked.at[first : first + step, :width]
                size = at.size * rows.shape[1]
                space = np.empty(size, np.uint8) if len(space) < size else space
                taken = np.take(rows, at, axis=0, out=space[:size].reshape(*at.shape, -1), mode="clip")
                total = np.add.reduce(taken, axis=1, dtype=np.uint8)
                hit = np.flatnonzero(total >= need[first : first + step, None])
                found.append((hit // rows.shape[1] + first, hit % rows.shape[1] + k * SUMMED))
                first += step
        return tuple(np.concatenate(x) for x in zip(*found))


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of single rows of two matrices."""
    some = [np.einsum("ij,ij->i", a.take(i[c : c + SINGLE], 0), b.take(j[c : c + SINGLE], 0)) for c in range(0, len(i), SINGLE)]
    return np.concatenate(some) if some else np.zeros(0, a.dtype)


def similarity_topk(
    queries: DataFrame, items: DataFrame, k: int, positive: bool = True, namespaces: str = "none", decimals: int | None = DECIMALS,
    not_itself: bool = False, dim: int | None = None, groups: bool = False, normalise: bool = True,
) -> DataFrame:
    """qid, seq, score, rank: the k best ``items`` (seq, ns, vector) of each of ``queries`` (qid, ns, vector).

    Without ``normalise`` scores are products, for vectors that are scaled already. ``groups`` asks for the k best of each namespace of items instead of the k best of all.

    With ``dim``, vectors are given as bucket numbers, one for each token, and become counts in workers:
    whole numbers, so products are exact and equal texts tie exactly.

    ``positive`` asks for scores over 0. ``namespaces``: "none" compares all; "equal" asks for the same
    namespace; "visible" lets queries without namespace see all and items without one be seen by all.
    """
    spark = queries.sparkSession
    ship(spark)
    kind = "array<double>" if dim is None else "array<int>"
    blocks = _item_blocks(items, dim, normalise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, ASKED):
            ids, names = batch["qid"].to_numpy(), batch["ns"].to_pylist()
            codes: dict[str | None, int] = {None: 0}
            number = lambda values: np.array([codes.setdefault(v, len(codes)) for v in values], np.int64)
            ns, best = number(names), {}
            # Queries of one namespace stand together, so that they meet only the items they may find.
            whose = [np.arange(len(ids))] if namespaces == "none" else [np.flatnonzero(ns == c) for c in np.unique(ns)]
            summed = dim is not None and normalise
            if summed:
                whose, scales = _alike(batch["vector"].combine_chunks(), whose, dim, positive)
            parts = []
            for w, rows in ((w, x[i : i + 512]) for w, x in enumerate(whose) for i in range(0, len(x), 512)):
                q = _matrix(batch["vector"].take(pa.array(rows)), dim)
                size = _norms(q) if normalise else np.ones(len(q))
                parts.append((rows, q, size, _scaled(q, size), _Rows(q, scales[w]) if summed and scales[w] else None))

            def meet(name: int, rows: np.ndarray, q: np.ndarray, size: np.ndarray, small: np.ndarray, taken: _Rows | None, seq: np.ndarray, x: np.ndarray, norms: np.ndarray, less: np.ndarray, sums: _Sums | None) -> None:
                """The scores of some queries with some items; those that a rough product shows to be under the k-th best are not made."""
                if name not in best:
                    best[name] = _Best(len(ids), k)
                now = best[name]
                least = now.score[rows, -1]
                slack = _slack(small, less, decimals)
                if len(seq) and np.isfinite(slack) and (full := least > -np.inf).any():
                    if not full.all():
                        for some in (np.flatnonzero(full), np.flatnonzero(~full)):
                            meet(name, rows[some], q[some], size[some], small[some], taken and taken.only(some), seq, x, norms, less, sums)
                        return
                    enough, pairs = (least - slack).astype(np.float32), len(rows) * len(seq)
                    i = j = None
                    if taken is not None:
                        i, j = sums.reaching(taken, size * (least - slack))
                        if len(i) * 24 <= pairs:
                            near = _products(small, less, i, j) >= enough[i]
                            i, j = i[near], j[near]
                        else:
                            i = None
                    if i is None:
                        i, j = np.nonzero(small @ less.T >= enough[:, None])
                    if len(i) * 16 <= pairs:
                        both = size[i] * norms[j]
                        score = np.divide(_products(q, x, i, j), both, out=np.zeros_like(both), where=both > 0)
                        if decimals is not None:
                            score = np.round(score, decimals)
                        keep = score >= least[i]
                        if positive:
                            keep &= score > 0
                        if not_itself:
                            keep &= seq[j] != ids[rows[i]]
                        if keep.any():
                            now.merge(rows, i[keep], score[keep], seq[j[keep]])
                        return
                both = np.outer(size, norms)
                score = np.divide(q @ x.T, both, out=np.zeros_like(both), where=both > 0)
                if decimals is not None:
                    score = np.round(score, decimals)
                if positive:
                    score[score <= 0] = -np.inf
                if not_itself:
                    score[seq == ids[rows, None]] = -np.inf
                now.add(rows, score, seq)

            for seq, own_names, x, norms in blocks():
                own, items = number(own_names), (seq, x, norms, _scaled(x, norms))
                counted = lambda some: (*some, _Sums(some[3]) if summed else None)
                seen: dict[tuple, tuple] = {}

                def among(mine: int, name: int, own: np.ndarray = own, items: tuple = items, seen: dict = seen, counted: Callable = counted) -> tuple:
                    """The items that queries of a namespace may find, of one namespace of items if ``groups``."""
                    if (mine, name) not in seen:
                        of = np.ones(len(own), bool)
                        if namespaces == "equal":
                            of &= own == mine
                        elif namespaces == "visible" and mine:
                            of &= (own == mine) | (own == 0)
                        if groups:
                            of &= own == name
                        seen[mine, name] = counted(items if of.all() else tuple(c[of] for c in items))
                    return seen[mine, name]

                for rows, *asked_for in parts:
                    mine = int(ns[rows[0]]) if namespaces != "none" else 0
                    for name in np.unique(own).tolist() if groups else [-1]:
                        some = among(mine, name)
                        if len(some[0]):
                            meet(name, rows, *asked_for, *some)
            for b in best.values():
                i, r = np.nonzero(b.score > -np.inf)
                columns = (pa.array(ids[i]), pa.array(b.seq[i, r]), pa.array(b.score[i, r] + 0.0), pa.array((r + 1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns), ["qid", "seq", "score", "rank"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("ns").cast("string").alias("ns"), F.col("vector").cast(kind).alias("vector"))
    # As many queries in each task, and full turns of the cores: every task goes through all items.
    cores = spark.sparkContext.defaultParallelism
    dealt = asked.repartition(cores * max(1, -(-queries.count() // (cores * ASKED))))
    return dealt.mapInArrow(run, "qid bigint, seq bigint, score double, rank int")


def _alike(vectors: pa.Array, whose: list[np.ndarray], dim: int, positive: bool) -> tuple[list[np.ndarray], list[float]]:
    """The same queries in groups of alike norms, by number of rows, and a scale for each group's sums; 0 where queries are too long for them.

    With ``positive``, queries without tokens find nothing and are left out.
    """
    n, size = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for i in range(0, len(vectors), 2048):
        counts = _matrix(vectors.slice(i, 2048), dim)
        n[i : i + 2048], size[i : i + 2048] = _rows_of(counts).sum(axis=1), _norms(counts)
    kind = np.where(n <= MOST_ROWS, np.floor(np.log(np.maximum(size, 1)) / np.log(ALIKE)), -1).astype(int)
    groups, scales = [], []
    for rows in whose:
        rows = rows[size[rows] > 0] if positive else rows
        for c in np.unique(kind[rows]):
            own = rows[kind[rows] == c]
            groups.append(own[np.argsort(n[own], kind="stable")])
            scales.append(float((254 - n[own].max() / 2) / max(size[own].max(), 1)) if c >= 0 else 0.0)
    return groups, scales


def _met(items: DataFrame, fold: Callable[[], Callable], schema: str, spaces: bool = False) -> DataFrame:
    """Rows of a fold over all pairs of ``items`` (seq, ns, vector), one fold a task.

    ``fold()`` gives a function that takes two blocks (vectors and norms of each), whether two have one namespace if
    ``spaces`` asks for it, and which pairs count (None: all), so that each pair comes once; called with nothing, it
    gives the columns of its rows. Pairs stay in workers.
    """
    ship(items.sparkSession)
    blocks, names_of = _item_blocks(items, None, True), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took = fold()
        for batch in _gathered(batches, ASKED):
            batch = batch.sort_by("seq")
            every, names = batch["seq"].to_numpy(), np.array(batch["ns"].to_pylist(), object)
            for seq, own, x, norms in blocks():
                least, most = seq.min(), seq.max()
                for first in range(0, int(np.searchsorted(every, most)), 512):  # later ones come before no item of the block
                    part = slice(first, first + 512)
                    q, ids = _matrix(batch["vector"].slice(first, 512)), every[part]
                    once = None if ids[-1] < least else ids[:, None] < seq[None, :]
                    took(q, _norms(q), x, norms, names[part, None] == own[None, :] if spaces else None, once)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in took()], names_of)

    asked = items.select(F.col("seq").cast("long").alias("seq"), F.col("ns").cast("string").alias("ns"), F.col("vector").cast("array<double>").alias("vector"))
    # Rows of all places in each task, as the first ones have the most pairs.
    return asked.repartition(max(asked.sparkSession.sparkContext.defaultParallelism, asked.rdd.getNumPartitions())).mapInArrow(run, schema)


def _pairs(items: DataFrame, decimals: int, fold: Callable[[], Callable], schema: str) -> DataFrame:
    """The same for a fold that takes (scores, whether the two have one namespace) of blocks of pairs."""

    def scored() -> Callable:
        took = fold()

        def met(*blocks: np.ndarray):
            if not blocks:
                return took()
            q, size, x, norms, same, once = blocks
            both = np.outer(size, norms)
            score = np.round(np.divide(q @ x.T, both, out=np.zeros_like(both), where=both > 0), decimals) + 0.0
            took(*((score.ravel(), same.ravel()) if once is None else (score[once], same[once])))

        return met

    return _met(items, scored, schema, spaces=True)


def pair_extremes(items: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """(same, n, low, high): number, least and greatest cosine of the pairs within and across namespaces; a task gives two rows."""

    def fold() -> Callable:
        n, low, high = np.zeros(2, np.int64), np.full(2, np.inf), np.full(2, -np.inf)

        def took(score: np.ndarray | None = None, same: np.ndarray | None = None):
            if score is None:
                some = np.flatnonzero(n)
                return some == 1, n[some], low[some], high[some]
            for kind in (0, 1):
                own = score[same == kind]
                if len(own):
                    n[kind], low[kind], high[kind] = n[kind] + len(own), min(low[kind], own.min()), max(high[kind], own.max())

        return took

    found = _pairs(items, decimals, fold, "same boolean, n bigint, low double, high double")
    return found.groupBy("same").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


#: Classes of rough cosines from -1 to 1, with some beyond both ends.
ROUGH, BEYOND = 131_072, 4


def pair_at(items: DataFrame, place: Callable[[int], int], decimals: int = DECIMALS, step: int = 65_536) -> tuple[int, float | None]:
    """(n, score): the number of pairs, and of their sorted cosines the one at ``place(n)``, from 0; none without pairs.

    A first pass counts classes of products in single precision. As these are near the scores, the score sought lies
    within a class of the one that holds the place. A second pass counts what is surely below that range, again by
    rough products, and scores exactly only what may be in it: rounded scores are whole numbers of the last decimal,
    and of these it counts classes, at most ``step`` + 1 a task. Where a class holds more than one number, passes over the
    range of that class follow.
    """
    scale, ends = 10**decimals, ROUGH // 2 + BEYOND

    def rough() -> Callable:
        counts = np.zeros(2 * ends, np.int64)

        def took(*blocks: np.ndarray):
            if not blocks:
                some = np.flatnonzero(counts)
                return some, counts[some]
            q, size, x, norms, _, once = blocks
            classes = (_scaled(q, size) * np.float32(ROUGH // 2)) @ _scaled(x, norms).T
            classes += np.float32(ends)
            whole = np.clip(np.nan_to_num(classes), 0, 2 * ends - 1).astype(np.int32)
            counts[:] += np.bincount(whole.ravel() if once is None else whole[once], minlength=2 * ends)

        return took

    classes = _met(items, rough, "class bigint, c bigint").groupBy("class").agg(F.sum("c").alias("c")).orderBy("class").collect()
    total = sum(r["c"] for r in classes)
    if not total:
        return 0, None
    left = place(total)
    before = 0
    for r in classes:  # 2 * ends at most
        if before + r["c"] > left:
            break
        before += r["c"]
    # A class each way is 1 / 65536, above the usual error of rough products; if the place should not be there, all is scored exactly.
    low, high = ((r["class"] + k - ends) * scale // (ROUGH // 2) for k in (-1, 2))
    while True:
        width = max(1, -(-(high - low) // step))

        def fine(low=low, high=high, width=width) -> Callable:
            counts: dict[int, int] = {}

            def took(*blocks: np.ndarray):
                if not blocks:
                    return np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
                q, size, x, norms, _, once = blocks
                a, b = _scaled(q, size), _scaled(x, norms)
                slack = _slack(a, b, decimals)
                product = a @ b.T
                under, over = product < np.float32(low / scale - slack), product > np.float32(high / scale + slack)
                if once is not None:
                    under, over = under & once, over | ~once
                counts[-1] = counts.get(-1, 0) + int(np.count_nonzero(under))
                i, j = np.nonzero(~(under | over))
                for some in range(0, len(i), 65_536):
                    m, n = i[some : some + 65_536], j[some : some + 65_536]
                    both = size[m] * norms[n]
                    score = np.divide(np.einsum("ij,ij->i", q[m], x[n]), both, out=np.zeros_like(both), where=both > 0)
                    whole = np.rint(np.round(score, decimals) * scale).astype(np.int64)
                    whole = whole[whole < high]
                    for c, k in zip(*np.unique(np.where(whole < low, -1, (whole - low) // width), return_counts=True)):
                        counts[int(c)] = counts.get(int(c), 0) + int(k)

            return took

        before = 0
        for r in _met(items, fine, "class bigint, c bigint").groupBy("class").agg(F.sum("c").alias("c")).orderBy("class").collect():  # step + 1 at most
            if before + r["c"] > left:
                break
            before += r["c"]
        if before + r["c"] <= left or r["class"] < 0:
            low, high = -2 * scale, 2 * scale
            continue
        if width == 1:
            return total, (low + r["class"]) / scale
        low, high = low + r["class"] * width, low + (r["class"] + 1) * width
