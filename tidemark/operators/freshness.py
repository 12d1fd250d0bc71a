"""Freshness in time: age limits, revalidation by content, and staleness as of a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .provenance import span_differs


def expired(epoch: Column, now: Column, max_age: Column | float | None) -> Column:
    """Older than ``max_age``; exactly that old is still fresh, and without a limit nothing expires."""
    return F.lit(False) if max_age is None else now - epoch > max_age


def revalidate(units: DataFrame, spans: DataFrame, current: DataFrame, now: float) -> DataFrame:
    """Units (unit, status, freshness_epoch) with current content looked up for their artifacts.

    One changed artifact makes a unit dirty; otherwise it is fresh as of ``now``. Artifacts of which nothing
    is known (no row in ``current``: artifact_id, text_hash) are passed over, so a unit of which nothing is
    known is fresh again.
    """
    looked = spans.join(current.where("text_hash IS NOT NULL"), "artifact_id")
    changed = looked.groupBy("unit").agg(F.max(span_differs(F.col("content_hash"), F.lit(""), F.col("text_hash"), F.lit(""))).alias("changed"))
    both = units.join(changed, "unit", "left")
    dirty = F.coalesce("changed", F.lit(False))
    return both.select(
        "unit", F.when(dirty, "dirty").otherwise("fresh").alias("status"),
        F.when(dirty, F.col("freshness_epoch")).otherwise(F.lit(now)).alias("freshness_epoch"),
    )


def as_of(log: DataFrame) -> DataFrame:
    """State of a key at each read of a log (key, seq, kind, content), kinds build, change, delete and read.

    With the latest build before a read: evicted if a delete came between, stale if a change to other
    content did, fresh if neither; unbuilt without a build. One sort by (key, seq) does it, no join.
    """
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    rows = log.withColumn("_built", F.last(F.when(is_("build"), F.struct("seq", "content")), ignorenulls=True).over(order))
    deleted = F.max(F.when(is_("delete"), F.col("seq"))).over(order)
    moved = is_("change") & F.coalesce(F.col("content") != F.col("_built.content"), F.lit(True))
    rows = rows.withColumn("_moved", F.when(moved, F.col("seq"))).withColumn("_deleted", deleted)
    rows = rows.withColumn("_moved", F.max("_moved").over(order))
    state = (
        F.when(F.col("_built").isNull(), "unbuilt").when(F.col("_deleted") > F.col("_built.seq"), "evicted")
        .when(F.col("_moved") > F.col("_built.seq"), "stale").otherwise("fresh")
    )
    return rows.where(is_("read")).select("key", "seq", state.alias("state"))
