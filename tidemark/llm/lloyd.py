"""Centroid clustering: plain Lloyd in integers.

Vectors become integers, floor(scale * x). Centroids start as the ``k`` vectors with the smallest hashes of
their ids and are broadcast, k small vectors; each round every task finds the nearest centroid of its vectors
(integer squared differences, one centroid after the other, the lowest index of equals) and gives one row a
centroid and component with the sum of its vectors; a groupBy adds the rows up and the new centroids are the
floors of the means. A round is one scan that shuffles at most k * (size + 2) numbers a task, however many
vectors one cluster has; nothing is kept between rounds and a lost task is simply run again, as everything is
exact and in no particular order.

Arithmetic is exact at every size: 32 or 64-bit integers as far as a bound on the components proves that
nothing overflows, Python integers for the batches beyond.

Edge cases: vectors that are null, of another length than ``size``, or with null or non-finite components
are left out; rows that repeat an id are vectors of their own (equal hashes go by their components); null ids
are clustered, and start no cluster while there are others; with fewer vectors than ``k`` each starts one; an
empty table gives an empty result; a distance or sum that is no 64-bit integer is null. Further columns of
the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Sums are split here into two columns that Spark adds up exactly.
LOW_BITS = 40
LONG = range(-(1 << 63), 1 << 63)


class Clusters(NamedTuple):
    """Final centroids (integers, as lists), and of each its vectors and the sum of their distances."""

    centroids: list[list[int]]
    counts: list[int]
    inertias: list[int]


def _vectors(table: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(vec_id, vector of doubles) of the vectors that take part."""
    vector = table[vector_col].cast("array<double>")
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = table.select(table[id_col].alias("vec_id"), vector.alias("vector"))
    return rows.where((F.size("vector") == size) & F.forall("vector", usable))


def _exact(most: int, size: int) -> type:
    """The narrowest type that holds squared distances of vectors with components up to ``most``."""
    bound = size * (2 * int(most)) ** 2
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def integers(vectors: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in the narrowest type in which squared distances are exact."""
    x = np.floor(scale * np.stack([np.asarray(v, np.float64) for v in vectors]))
    kind = _exact(np.abs(x).max(initial=0), x.shape[1])
    return x.astype(kind) if kind is not object else np.array([[int(v) for v in row] for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the centroid at the smallest squared distance (the lowest index of equals), and that distance."""
    kind = np.result_type(x.dtype, _exact(max(abs(v) for c in centroids for v in c), x.shape[1]))
    x = x.astype(kind)
    best = np.zeros(len(x), np.int32)
    least = None
    for i, c in enumerate(centroids):
        apart = x - np.array(c, kind)
        distance = (apart * apart).sum(axis=1) if kind == object else np.einsum("ij,ij->i", apart, apart)
        if least is None:
            least = distance
        else:
            nearer = (distance < least).astype(bool)
            best[nearer], least[nearer] = i, distance[nearer]
    return best, least


def _sums(vectors: DataFrame, centroids: list[list[int]], scale: float) -> tuple[list[list[int]], list[int], list[int]]:
    """Component sums, counts and sums of distances of each cluster; the driver gets one row a cluster."""
    size, k = len(centroids[0]), len(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, counts = [[0] * (size + 1) for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = integers(batch["vector"], scale)
            best, least = nearest(x, shared.value)
            counts += np.bincount(best, minlength=k)
            if least.dtype == object:
                least = np.minimum(least, LONG.stop)  # beyond, the sum is no 64-bit integer anyway
            x = np.column_stack([x.astype(least.dtype if least.dtype == object else np.int64), least])
            for i in np.unique(best).tolist():
                mine = x[best == i]
                if mine.dtype != object and len(mine) * float(np.abs(mine).max()) >= 2.0**62:
                    mine = mine.astype(object)
                totals[i] = [t + int(v) for t, v in zip(totals[i], mine.sum(axis=0))]
        found = [(i, j, t) for i in np.flatnonzero(counts).tolist() for j, t in enumerate([*totals[i], int(counts[i])])]
        low = [t & ((1 << LOW_BITS) - 1) for _, _, t in found]
        high = [Decimal(t >> LOW_BITS) for _, _, t in found]
        yield pd.DataFrame({"cluster": [i for i, _, _ in found], "place": [j for _, j, _ in found], "low": low, "high": high})

    parts = vectors.select("vector").mapInPandas(run, "cluster int, place int, low long, high decimal(38,0)")
    added = parts.groupBy("cluster", "place").agg(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("high").alias("high"))
    totals = [[0] * (size + 2) for _ in range(k)]
    for cluster, place, low, high in added.collect():  # size + 2 numbers a centroid
        totals[cluster][place] = (int(high) << LOW_BITS) + int(low)
    shared.unpersist()
    return [t[:size] for t in totals], [t[-1] for t in totals], [t[-2] for t in totals]


def starts(vectors: DataFrame, k: int, seed: int, scale: float) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    return [[int(v) for v in integers([row["vector"]], scale)[0]] for row in first]


def fit(
    table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: float = SCALE, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clusters:
    """Centroids after ``rounds`` rounds; an empty cluster's centroid stays where it is."""
    ship(table.sparkSession)
    vectors = _vectors(table, id_col, vector_col, size)
    centroids = starts(vectors, k, seed, scale)
    if not centroids:
        return Clusters([], [], [])
    for _ in range(rounds):
        sums, counts, _ = _sums(vectors, centroids, scale)
        centroids = [[s // n for s in row] if n else c for row, n, c in zip(sums, counts, centroids)]
    _, counts, inertias = _sums(vectors, centroids, scale)
    return Clusters(centroids, counts, inertias)


def centroid_digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(x: int) -> int | None:
    return x if x in LONG else None


def assign(table: DataFrame, clusters: Clusters, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    ship(table.sparkSession)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not clusters.centroids:
        return table.sparkSession.createDataFrame([], schema)
    centroids, total = clusters.centroids, _long(sum(clusters.inertias))
    inertias = pd.array([_long(x) for x in clusters.inertias], "Int64")
    digests = np.array([centroid_digest(c) for c in centroids])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, least = nearest(integers(batch["vector"], scale), centroids)
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"], "cluster": best, "distance": pd.array([_long(int(x)) for x in least], "Int64"),
                    "cluster_inertia": inertias[best], "inertia": pd.array([total] * len(batch), "Int64"), "centroid_sha256": digests[best],
                })

    return _vectors(table, id_col, vector_col, len(centroids[0])).mapInPandas(run, schema)


def clustered(table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, **how) -> DataFrame:
    """``fit`` and ``assign`` over one table."""
    names: dict[str, str] = {x: how[x] for x in ("id_col", "vector_col") if x in how}
    return assign(table, fit(table, k, rounds, size, **how), how.get("scale", SCALE), **names)
