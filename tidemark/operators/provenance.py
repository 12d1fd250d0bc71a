"""Provenance: indexes of artifacts and entities, what a change does to units, and related units.

``spans`` is the exploded form of units' provenance: (unit, artifact_id, version, content_hash), hashes and
versions null for edges that were only observed. Changes are (event_seq, artifact_id, version,
content_hash, kind). Indexes are views, so nothing has to be kept in step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key
from .sharing import keys_of, shared_best, shared_pairs


def artifact_index(units: DataFrame, unit: str = "id", spans: str = "source_spans", edges: str = "observed_edges") -> DataFrame:
    """(artifact_id, unit), each pair once."""
    ids = F.concat(F.transform(spans, lambda s: s["artifact_id"]), F.col(edges))
    return units.select(F.explode(F.array_distinct(ids)).alias("artifact_id"), F.col(unit).alias("unit"))


def entity_index(units: DataFrame, unit: str = "id", entities: str = "entities") -> DataFrame:
    """(entity, unit): stripped and in lower case, empty ones left out, each pair once."""
    keys = F.array_distinct(F.filter(F.transform(entities, entity_key), lambda e: e != ""))
    return units.select(F.explode(keys).alias("entity"), F.col(unit).alias("unit"))


def span_differs(old_hash: Column, old_version: Column, new_hash: Column, new_version: Column) -> Column:
    """Hashes decide where both are known, else versions; unknown is different."""
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    return (
        F.when(has(old_hash) & has(new_hash), old_hash != new_hash)
        .when(has(old_version) & has(new_version), old_version != new_version)
        .otherwise(F.lit(True))
    )


def change_actions(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """(event_seq, unit, action) for each unit that holds the changed artifact: evict, dirty or skip."""
    new = changes.select("event_seq", "artifact_id", F.col("version").alias("new_version"), F.col("content_hash").alias("new_hash"), "kind")
    differs = span_differs(F.col("content_hash"), F.col("version"), F.col("new_hash"), F.col("new_version"))
    both = new.join(spans, "artifact_id").groupBy("event_seq", "unit", "kind").agg(F.max(differs).alias("changed"))
    action = F.when(F.col("kind") == "delete", "evict").when(F.col("changed"), "dirty").otherwise("skip")
    return both.select("event_seq", "unit", action.alias("action"))


def change_summary(changes: DataFrame, actions: DataFrame) -> DataFrame:
    """Per event: matched units and how many were dirtied, skipped and evicted; zeros where none matched."""
    count = lambda what: F.count_if(F.col("action") == what)
    per = actions.groupBy("event_seq").agg(
        F.count("unit").alias("matched_units"), count("dirty").alias("dirtied"), count("skip").alias("skipped"), count("evict").alias("deleted")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return changes.select("event_seq").join(per, "event_seq", "left").select("event_seq", *(zero(c) for c in ("matched_units", "dirtied", "skipped", "deleted")))


def fold_actions(actions: DataFrame) -> DataFrame:
    """(unit, outcome, event_seq) of a batch in event order: the first eviction ends a unit; else any dirtying holds."""
    first = F.min(F.when(F.col("action") == "evict", F.col("event_seq")))
    dirty = F.min(F.when(F.col("action") == "dirty", F.col("event_seq")))
    per = actions.groupBy("unit").agg(first.alias("evicted"), dirty.alias("dirtied"))
    outcome = F.when(F.col("evicted").isNotNull(), "evicted").when(F.col("dirtied").isNotNull(), "dirty").otherwise("unchanged")
    return per.select("unit", outcome.alias("outcome"), F.coalesce("evicted", "dirtied").alias("event_seq"))


def until_evicted(actions: DataFrame) -> DataFrame:
    """The actions of a batch in event order: what comes after a unit's first eviction finds nothing."""
    gone = F.min(F.when(F.col("action") == "evict", F.col("event_seq"))).over(Window.partitionBy("unit"))
    return actions.withColumn("_gone", gone).where("_gone IS NULL OR event_seq <= _gone").drop("_gone")


def related_pairs(seeds: DataFrame, by_entity: DataFrame, by_artifact: DataFrame) -> DataFrame:
    """(seed, unit, relation): units that share an entity, else those that share a source; not the seed itself."""
    return shared_pairs(seeds, keys_of(by_entity, by_artifact)).select("seed", "unit", _relation().alias("relation"))


def related_topk(
    seeds: DataFrame, by_entity: DataFrame, by_artifact: DataFrame, units: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = 3
) -> DataFrame:
    """The best ``limit`` related units of each seed, fresh ones of the seed's namespace only, ties to the smaller seq.

    ``units`` has unit, ns, status, seq and features, of which ``score`` makes the scores of pairs (see ``shared_best``).
    """
    if limit <= 0:
        return seeds.select("seed", F.col("seed").alias("unit"), F.lit("").alias("relation"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    best = shared_best(seeds, keys_of(by_entity, by_artifact), units, score, limit)
    return best.join(units.select("unit", "seq"), "seq").select("seed", "unit", _relation().alias("relation"), "score", "rank")


def _relation() -> Column:
    return F.when(F.col("by_entity"), "shared_entity").otherwise("shared_source")
