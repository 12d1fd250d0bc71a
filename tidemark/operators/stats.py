"""Statistics of caches and stores, recent lists, and thresholds from examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import pair_at


def rate(part: Column, whole: Column) -> Column:
    """A ratio to three places, 0 over nothing."""
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), 3), F.lit(0.0))


def cache_stats(reads: DataFrame, n_units: int | Column, n_artifacts: int | Column) -> DataFrame:
    """One row of statistics from a read log (cache_hit, escalated: boolean)."""
    totals = reads.agg(F.count("*").alias("reads"), F.count_if("cache_hit").alias("hits"), F.count_if("escalated").alias("escalations"))
    units, artifacts = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (n_units, n_artifacts))
    return totals.select(
        units.alias("units"), artifacts.alias("tracked_artifacts"), "reads", "hits", "escalations",
        rate(F.col("escalations"), F.col("hits")).alias("escalation_rate"), rate(F.col("hits"), F.col("reads")).alias("hit_rate"),
    )


def store_stats(units: DataFrame, index: DataFrame) -> DataFrame:
    """Units, fresh and dirty ones, and distinct artifacts."""
    counts = units.agg(F.count("*").alias("units"), F.count_if(F.col("status") == "fresh").alias("fresh"), F.count_if(F.col("status") == "dirty").alias("dirty"))
    return counts.crossJoin(index.agg(F.countDistinct("artifact_id").alias("artifacts")))  # one row each


def recent(items: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """The last ``n`` distinct values of each key by first appearance, oldest first; a repeat doesn't move up."""
    first = items.groupBy(key, value).agg(F.min(order).alias("_first"))
    last = Window.partitionBy(key).orderBy(F.desc("_first"))
    kept = first.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n)
    values = F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    return kept.groupBy(key).agg(values.alias("recent"))


def touches(events: DataFrame, key: str, time: str) -> DataFrame:
    """Hits and last access of each unit from a log of builds and hits."""
    return events.groupBy(key).agg(F.count("*").alias("hits"), F.max(time).alias("last_access"))


def calibrate(extremes: DataFrame) -> DataFrame:
    """Thresholds halfway between the weakest positive and the strongest negative, from (same, low, high) of both kinds."""
    ends = extremes.agg(
        F.coalesce(F.min(F.when(F.col("same"), F.col("low"))), F.lit(0.4)).alias("low"), F.coalesce(F.max(F.when(~F.col("same"), F.col("high"))), F.lit(0.2)).alias("high")
    )
    hit = ends.select(F.bround((F.col("low") + F.col("high")) / 2, 3).alias("hit_threshold"))
    return hit.select("hit_threshold", F.bround(F.greatest(F.lit(0.0), F.col("hit_threshold") - 0.05), 3).alias("coverage_floor"))


def suggest(items: DataFrame) -> DataFrame:
    """Thresholds over the 95th of 100 parts of the cosines of all pairs of ``items`` (seq, ns, vector): an element of the list, not interpolated."""
    _, p95 = pair_at(items, lambda n: min(n - 1, int(0.95 * n)))
    found = items.sparkSession.createDataFrame([(p95,)], "p95 double")
    hit = F.when(F.col("p95").isNull(), 0.45).otherwise(F.bround(F.least(F.lit(0.9), F.col("p95") + 0.08), 3))
    floor = F.when(F.col("p95").isNull(), 0.4).otherwise(F.bround(F.greatest(F.lit(0.0), hit - 0.05), 3))
    return found.select(hit.alias("hit_threshold"), floor.alias("coverage_floor"))
