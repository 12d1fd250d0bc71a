"""The similarity join over several blocks of items, against plain numpy and SQL."""

import duckdb
import numpy as np

from tidemark.operators.similarity import similarity_topk
from tidemark.plans.queries import QUERIES, SQL


def test_blocks_ties_and_namespaces(spark):
    rnd = np.random.default_rng(4)
    words = rnd.integers(0, 12, (18_000, 5))
    words[::50] = words[0]  # copies tie over all blocks
    names = [None if i % 9 == 0 else "abc"[i % 3] for i in range(len(words))]
    items = spark.createDataFrame([(i, n, w.tolist()) for i, (n, w) in enumerate(zip(names, words))], "seq bigint, ns string, vector array<int>")
    asked = items.where("seq < 40 OR seq % 1000 = 0").withColumnRenamed("seq", "qid").coalesce(1)
    counts = np.array([np.bincount(w, minlength=256) for w in words], float)
    size = np.sqrt((counts * counts).sum(axis=1))
    for how in ("none", "equal", "visible"):
        got = {}
        for r in similarity_topk(asked, items, 4, namespaces=how, decimals=None, dim=256).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["seq"], r["score"]))
        for q in (r["qid"] for r in asked.collect()):
            score = counts @ counts[q] / (size[q] * size)
            may = [how == "none" or n == names[q] or how == "visible" and None in (n, names[q]) for n in names]
            order = [i for i in np.lexsort((np.arange(len(words)), -score)) if may[i] and score[i] > 0][:4]
            assert sorted(got.get(q, [])) == [(k, i, score[i]) for k, i in enumerate(order, 1)], (how, q)


def test_route_by_claim_rounds_once(spark):
    """On these rows some scores round otherwise after a first rounding to 9 places."""
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    assert sorted(map(tuple, QUERIES["route_by_claim"](spark, d).collect())) == sorted(con.sql(SQL["route_by_claim"]).fetchall())
