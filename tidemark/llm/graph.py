"""Connected components of a table of edges, by alternating large-star and small-star steps, or in one task if few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Edges up to which one task connects them: so few cost less than the jobs of a step.
FEW = 10_000


class Sets:
    """Union-find; the smallest name of a set stands for it."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, x):
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x] = root
            x = y
        return root

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, kind = Sets(), None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                sets.join(a, b)
        nodes = sorted({*sets.up, *sets.up.values()})
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([sets.top(x) for x in nodes], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return written(edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"), "components")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b of one type); a component is named by its smallest node.

    Steps replace edges by edges to the smallest neighbour, linear in the edges whatever a node's degree;
    each is written to the shared folder. Nodes with only an edge to themselves are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.select(high.alias("a"), low.alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    if 0 < mark[0] <= FEW:
        found = _in_one_task(now)
        discard(now)
        return found
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == last:
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
