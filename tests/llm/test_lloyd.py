"""Clusters against plain Python: rows that take no part, repeated and null ids, ties, few rows, very large components."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm.lloyd import clustered

SCHEMA = "vec_id long, embedding array<float>, cluster int, vector string, n long"


def plain(rows, k, rounds=5, size=64):
    kept = [
        (i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(t) // len(mine[i]) for t in zip(*mine[i])] if i in mine else c for i, c in enumerate(centroids)]
    found, sums = [(i, *near(v)) for i, v in kept], {}
    for _, d, c in found:
        sums[c] = sums.get(c, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted([(i, c, long(d), long(sums[c]), long(sum(sums.values())), digest(c)) for i, d, c in found], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def single(*xs):
    return [None if x is None else float(np.float32(x)) for x in xs]


EDGES = [
    (2**53 + 1, single(0.5, -0.2)), (None, single(1, 2)), (None, None), (3, single(1, None)), (4, single(math.nan, 1)), (5, single(1)), (5, []),
    (6, single(1e30, -2)), (7, single(-3e38, 3e38)), (7, single(-3e38, 3e38)), (8, single(1e6, 0)), (9, single(0, 0)), (9, single(0, 0)),
    (10, single(math.inf, 0)), (11, single(0, -0.001)), (-12, single(4095.9, -4096)),
]


@pytest.mark.parametrize("k", [1, 2, 3, 40])
@pytest.mark.parametrize("most", [1e300, 1e7])
def test_edges(spark, k, most):
    rows = [(i, v) for i, v in EDGES if not v or not any(x and math.isfinite(x) and abs(x) > most for x in v)]
    table = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], SCHEMA).repartition(3)
    assert rows_of(clustered(table, k=k, size=2)) == plain(rows, k, size=2)


def test_ties_and_spread_batches(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(i) // 3, single(*(rnd.integers(-3, 4, 4) / 256))) for i in range(700)]  # many equal distances
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(7)
    assert rows_of(clustered(table, k=9, size=4)) == plain(rows, 9, size=4)


def test_nothing(spark):
    assert clustered(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).collect() == []
    assert clustered(spark.createDataFrame([], SCHEMA)).collect() == []
