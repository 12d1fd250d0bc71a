"""Related units against brute force: keys of many and of few units, blocks, namespaces, ties."""

import random

import numpy as np
import pyarrow as pa

from tidemark.operators import provenance as O
from tidemark.operators import sharing


def _index(spark, rng, units, name, keys, n):
    rows = [(f"{name}{int(rng.paretovariate(0.7)) % keys}", u) for u in units for _ in range(rng.randint(0, n))] + [(None, units[0]), (None, units[1])]
    key = "entity" if name == "e" else "artifact_id"
    return spark.createDataFrame(rows, f"{key} string, unit string"), {(k, u) for k, u in rows if k is not None}


def _related(a, b, ents, arts):
    of = lambda held, u: {k for k, x in held if x == u}
    return "shared_entity" if of(ents, a) & of(ents, b) else "shared_source" if of(arts, a) & of(arts, b) else None


def test_pairs_and_best_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharing, "UNITS", 16)
    rng = random.Random(3)
    units = [f"u{i}" for i in range(50)]
    by_entity, ents = _index(spark, rng, units, "e", 40, 2)
    by_artifact, arts = _index(spark, rng, units, "a", 300, 6)
    asked = units[:30] + units[:3] + ["unknown"]
    seeds = spark.createDataFrame([(u,) for u in asked], "seed string")
    want = {(a, b): r for a in set(asked) for b in units if a != b and (r := _related(a, b, ents, arts))}
    got = [tuple(r) for r in O.related_pairs(seeds, by_entity, by_artifact).collect()]
    assert len(got) == len(want) and {(a, b): r for a, b, r in got} == want
    about = [(u, [None, "x", "y"][i % 3], "dirty" if i % 5 == 0 else "fresh", 100 - i, [float(i % 4)]) for i, u in enumerate(units)]
    table = spark.createDataFrame(about, "unit string, ns string, status string, seq bigint, features array<double>")
    known = {r[0]: r for r in about}
    best = O.related_topk(seeds, by_entity, by_artifact, table, lambda a, b: -abs(a[:, 0, None] - b[:, 0]), 2)
    found = sorted((r["seed"], r["rank"], r["unit"], r["relation"], r["score"]) for r in best.collect())
    expected = []
    for a in set(asked) & set(units):
        some = [(-abs(known[a][4][0] - known[b][4][0]), known[b][3], b) for (s, b) in want if s == a and known[b][1] == known[a][1] is not None and known[b][2] == "fresh"]
        expected += [(a, k + 1, b, want[a, b], score) for k, (score, _, b) in enumerate(sorted(some, key=lambda x: (-x[0], x[1]))[:2])]
    assert found == sorted(expected)
    assert O.related_topk(seeds, by_entity, by_artifact, table, lambda a, b: a, 0).count() == 0


def test_pairs_leave_tasks_once(spark):
    """Units that share 40 keys make a row a pair, not one for each key, and no row of pairs is shuffled."""
    rows = [(f"a{k}", u) for u in range(60) for k in range(40)]
    by_artifact = spark.createDataFrame(rows, "artifact_id string, unit bigint")
    none = spark.createDataFrame([], "entity string, unit bigint")
    found = O.related_pairs(spark.createDataFrame([(u,) for u in range(60)], "seed bigint"), none, by_artifact)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0]
    assert found.count() == 60 * 59


def test_rows_of_bits_and_lists_agree():
    rng = random.Random(5)
    lists = pa.array([[f"k{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))] or None for _ in range(150)], pa.list_(pa.string()))
    asked = pa.array([["k1", "other"], [], ["k2", "k3"], None, ["k30"]], pa.list_(pa.string()))
    want = np.array([[bool(set(a or []) & set(b or [])) for b in lists.to_pylist()] for a in asked.to_pylist()])
    for least in (1, 8, 1000):
        held = sharing.Holders(lists, least)
        assert (held.sharing(*held.codes(asked), len(asked)) == want).all()
