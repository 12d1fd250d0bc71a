"""The cache as an object: single reads and changes over a store, and whole tables of reads at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import written
from ..functions import text as T
from ..functions.synthesis import Chunk
from ..functions.vectors import hashed_vectors
from ..operators import evidence as E
from ..operators import matching as M
from ..operators import provenance as O
from ..operators.similarity import similarity_topk
from ..sources.retrievers import Retriever
from ..sources.store import UNIT_SCHEMA, Store
from .engine import Engine, Result, Settings, Unit, text_hash


def as_function(spark: SparkSession, retriever: Retriever | Callable[[str, str | None], Iterable[Any]]) -> Callable[[str, str | None], list[Chunk]]:
    """A retriever for single queries: a table retriever runs a one-row batch."""
    if not isinstance(retriever, Retriever):
        return lambda query, ns: [c if isinstance(c, Chunk) else Chunk(*c) for c in retriever(query, ns)]

    def run(query: str, ns: str | None) -> list[Chunk]:
        asked = spark.createDataFrame([(0, query, ns)], "qid bigint, query string, namespace string")
        rows = retriever.retrieve(asked).orderBy("pos").collect()  # at most k rows
        return [Chunk(r["artifact_id"], r["text"], r["version"] or "") for r in rows]

    return run


class ContextCache:
    """Reads answered from units of understanding; changes of sources make units dirty or remove them."""

    def __init__(
        self, spark: SparkSession, retriever: Retriever | Callable[[str, str | None], Iterable[Any]], synthesizer: Any = None, *, embedder: Any = None,
        settings: Settings | None = None, store: Store | None = None, clock: Callable[[], float] = time.time,
    ):
        self.spark, self.store, self.pending = spark, store, []
        self.engine = Engine(as_function(spark, retriever), synthesizer, embedder, settings, clock, self._keep if store is not None else None)
        if store is not None:
            rows = store.all().orderBy("place").drop("place").collect()  # the units of one application's cache
            for r in rows:
                unit = Unit.of_row(r.asDict(recursive=True))
                if not unit.understanding_embedding and unit.understanding:
                    self.engine.embed(unit)
                    self._keep("put", unit)
                self.engine.add(unit)
            self.flush()

    def _keep(self, op: str, unit: Unit) -> None:
        self.pending.append((op, unit.id, unit.row()))

    def flush(self) -> None:
        """Append what changed since the last call to the store."""
        last = {key: (op, row) for op, key, row in self.pending}
        self.pending = []
        puts = [row for op, row in last.values() if op == "put"]
        gone = [key for key, (op, _) in last.items() if op == "delete"]
        if puts or gone:
            self.store.write(self.spark.createDataFrame(puts, UNIT_SCHEMA), gone)

    def get(self, query: str, *, namespace: str | None = None, related: int = 3, strategy: str | None = None) -> Result:
        out = self.engine.get(query, namespace, related, strategy)
        self.flush()
        return out

    def invalidate(self, artifact_id: str, *, version: str = "", content_hash: str = "", kind: str = "update") -> dict[str, Any]:
        out = self.engine.change(artifact_id, content_hash, version, kind)
        self.flush()
        return out

    def source_changed(self, artifact_id: str, *, text: str | None = None, version: str | None = None) -> dict[str, Any]:
        return self.invalidate(artifact_id, version=version or "", content_hash="" if text is None else text_hash(text))

    def source_deleted(self, artifact_id: str) -> dict[str, Any]:
        return self.invalidate(artifact_id, kind="delete")

    def apply_changes(self, events: DataFrame) -> list[dict[str, Any]]:
        """The events (artifact_id, version, content_hash, kind) of a dispatcher, in order; the store gets one batch."""
        rows = events.orderBy("seq", "pos").toLocalIterator()
        out = [self.engine.change(e["artifact_id"], e["content_hash"] or "", e["version"] or "", e["kind"]) for e in rows]
        self.flush()
        return out

    def drill(self, unit_id: str) -> list[Chunk]:
        unit = self.engine.units.get(unit_id)
        return list(unit.evidence) if unit else []

    def widen(self, query: str, *, namespace: str | None = None) -> list[Chunk]:
        """What the sources give for a query, past any gate."""
        return list(self.engine.fetch(query, namespace))

    def stats(self) -> dict[str, Any]:
        return self.engine.stats()


def read_batch(
    reads: DataFrame, units: DataFrame, retriever: Retriever, synthesize: Callable[[Column, Column], Column] = E.stub_synthesis,
    hit_threshold: float = 0.6, coverage_floor: float = 0.5, weight: float = M.UNDERSTANDING_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """All ``reads`` (qid, query, namespace) against the units as they are now: (results, units built).

    ``units`` has unit_seq, id, namespace, status, seed, understanding (unit-length vectors, the latter null
    without digest), claim_vectors, evidence. Reads of one snapshot don't see each other's units; equal
    (namespace, query) pairs build one unit. Results: qid, outcome, unit_id, confidence, coverage, escalated,
    evidence. A blended score is a product with a blended vector, so the best unit is a similarity join.
    """
    ns = F.coalesce("namespace", F.lit(""))
    asked = written(hashed_vectors(reads.select("qid", "query", ns.alias("namespace")), ["qid", "query", "namespace"], "query"), "reads")
    blended = F.when(F.col("understanding").isNull(), F.col("seed")).otherwise(
        F.zip_with("understanding", "seed", lambda u, s: weight * u + (1 - weight) * s)
    )
    items = units.select(F.col("unit_seq").alias("seq"), F.col("namespace").alias("ns"), blended.alias("vector"))
    best = similarity_topk(asked.withColumnRenamed("namespace", "ns"), items, 1, positive=False, namespaces="equal", normalise=False)
    matched = asked.join(best.select("qid", F.col("seq").alias("unit_seq"), "score"), "qid", "left")
    held = units.select("unit_seq", F.col("id").alias("unit_id"), "status", "claim_vectors", "evidence")
    matched = matched.join(held, "unit_seq", "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    outcome = M.classify(F.col("score"), hit_threshold, F.col("status"), F.lit(False))
    coverage = M.coverage(F.col("vector"), F.col("claim_vectors"))
    matched = written(matched.withColumn("outcome", outcome).withColumn("coverage", coverage), "matched")
    under = (F.col("outcome") == "hit_fresh") & (F.col("coverage") < coverage_floor)
    fetch = matched.where(under | (F.col("outcome") != "hit_fresh")).select("qid", "query", F.nullif("namespace", F.lit("")).alias("namespace"))
    chunk = F.struct("artifact_id", "text", "version")
    found = retriever.retrieve(fetch).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    none = F.array().cast("array<struct<artifact_id:string,text:string,version:string>>")
    both = matched.join(found, "qid", "left").withColumn("chunks", F.coalesce("chunks", none))
    built = both.where("outcome <> 'hit_fresh'").withColumn("synthesis", synthesize(F.col("query"), F.col("chunks")))
    new = E.materialize(built.dropDuplicates(["namespace", "query"]))
    had = F.coalesce(F.col("evidence"), none)
    evidence = F.when(F.col("outcome") != "hit_fresh", F.col("chunks")).when(under, E.augment(had, F.col("chunks"))).otherwise(had)
    results = both.select(
        "qid", "outcome", F.when(F.col("outcome") == "miss", T.unit_id(F.col("namespace"), F.col("query"))).otherwise(F.col("unit_id")).alias("unit_id"),
        F.when(F.col("outcome") == "miss", F.greatest("score", F.lit(0.0))).otherwise(F.col("score")).alias("confidence"),
        "coverage", under.alias("escalated"), evidence.alias("evidence"),
    )
    return results, new


def apply_changes(store: Store, changes: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Apply a table of change events to a store, set by set, as one batch; returns (event_seq, unit, action)."""
    units = store.all()
    spans = units.select(F.col("id").alias("unit"), F.explode("provenance.source_spans").alias("s")).select("unit", "s.artifact_id", "s.version", "s.content_hash")
    edges = units.select(F.col("id").alias("unit"), F.explode("provenance.observed_edges").alias("artifact_id"))
    both = spans.unionByName(edges, allowMissingColumns=True)
    actions = written(O.until_evicted(O.change_actions(changes, both)), "actions")
    ends = written(O.fold_actions(actions), "outcomes")
    dirty = units.join(ends.where("outcome = 'dirty'").select(F.col("unit").alias("id")), "id").withColumn("status", F.lit("dirty"))
    gone = ends.where("outcome = 'evicted'").select(F.col("unit").alias("id"))
    store.write(dirty.withColumn("seq", F.col("place.first_seq")).drop("place"), gone, batch_id)
    return actions
