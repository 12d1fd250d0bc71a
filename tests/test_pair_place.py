"""The place of a percentile over all pairs takes two passes over them."""

import numpy as np

from tidemark.operators import similarity


def test_place_is_found_in_two_passes(spark, monkeypatch):
    passes, plain = [], similarity._item_blocks
    monkeypatch.setattr(similarity, "_item_blocks", lambda *a: passes.append(1) or plain(*a))
    x = np.random.default_rng(1).normal(size=(200, 8))
    items = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "seq bigint, ns string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    scores = np.sort((u @ u.T)[np.triu_indices(200, 1)])
    n, score = similarity.pair_at(items, lambda n: int(0.95 * n))
    assert n == len(scores) and abs(score - scores[int(0.95 * n)]) < 2e-9 and len(passes) == 2
