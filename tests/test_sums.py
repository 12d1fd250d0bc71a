"""Sums of small whole numbers in place of products: what they let through, and that they stay under 256."""

import numpy as np
import pyarrow as pa

from tidemark.operators import similarity as S


def _lists(rnd, n, most, dim):
    return [rnd.choice(dim, rnd.integers(0, most), p=np.arange(dim, 0, -1) / (dim * (dim + 1) / 2)).tolist() for _ in range(n)]


def test_sums_let_all_near_pairs_through(monkeypatch):
    monkeypatch.setattr(S, "SUMMED", 100)
    monkeypatch.setattr(S, "SUM_BYTES", 5000)
    rnd = np.random.default_rng(7)
    dim = 32
    lists = pa.array([[], [3] * 40, [1] * 7 + [2] * 3, *_lists(rnd, 150, 60, dim), *_lists(rnd, 5, 400, dim)], pa.list_(pa.int32()))
    counts, items = S._matrix(lists, dim), S._matrix(pa.array([[3] * 9, *_lists(rnd, 350, 300, dim)], pa.list_(pa.int32())), dim)
    size, less = S._norms(counts), S._scaled(items, S._norms(items))
    groups, scales = S._alike(lists, [np.arange(len(lists))], dim, True)
    assert sorted(np.concatenate(groups)) == np.flatnonzero(size > 0).tolist() and 0.0 in scales
    few = []
    for rows, scale in zip(groups, scales):
        exact = counts[rows] @ less.T.astype(float)
        assert scale == 0 or (scale * exact + S._rows_of(counts[rows]).sum(axis=1)[:, None] / 2 < 255.5).all()
        for place in (1, 5) if scale else ():
            least = np.sort(exact, axis=1)[:, -place] - 1e-6 * size[rows]
            i, j = S._Sums(less).reaching(S._Rows(counts[rows], scale), least)
            hit = np.zeros(exact.shape, bool)
            hit[i, j] = True
            assert len(i) == hit.sum() and hit[exact >= least[:, None]].all()
            few.append(hit.mean())
    assert np.mean(few) < 0.3
