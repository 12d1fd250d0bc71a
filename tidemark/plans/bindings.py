"""The tables as inputs of the operators: corpus chunks, read queries, dense units, units with provenance, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where a small table is fewer partitions than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; the namespace is their language."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), "doc_id").alias("artifact_id"), "text", F.lit("v1").alias("version"),
        F.col("lang").alias("namespace"), "source",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries; the namespace goes round the languages and none."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    ns = F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.pmod("conv_id", F.lit(5)).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "turn", F.col("text").alias("query"), ns.alias("namespace"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("ns"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units: each line item's part is a span (hash and version unknown for some), its supplier an observed edge."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    part = rows.select(
        F.col("l_orderkey").alias("unit"), F.concat(F.lit("part:"), "l_partkey").alias("artifact_id"), F.lit("v1").alias("version"),
        F.when(F.col("l_returnflag") == "N", T.content_hash(F.concat(F.lit("part "), "l_partkey"))).otherwise(F.lit("")).alias("content_hash"),
    )
    edge = rows.select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("supplier:"), "l_suppkey").alias("artifact_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return part.unionAll(edge)


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their spans and observed edges as arrays, in line order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    per = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    span = lambda r: F.struct(
        F.concat(F.lit("part:"), r["l_partkey"]).alias("artifact_id"), F.lit("v1").alias("version"), F.lit(None).cast("string").alias("span"),
        T.content_hash(F.concat(F.lit("part "), r["l_partkey"])).alias("content_hash"),
    )
    return per.select("id", F.transform("x", span).alias("source_spans"), F.transform("x", lambda r: F.concat(F.lit("supplier:"), r["l_suppkey"])).alias("observed_edges"))


def part_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as change events: same hash, another hash, version only, nothing known, or deletion, by size."""
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_size", F.lit(5))
    same = T.content_hash(F.concat(F.lit("part "), "p_partkey"))
    return p.select(
        F.col("p_partkey").alias("event_seq"), F.concat(F.lit("part:"), "p_partkey").alias("artifact_id"),
        F.when(kind == 2, "v2").when(kind == 3, "").otherwise("v1").alias("version"),
        F.when(kind == 0, same).when(kind == 1, T.content_hash(F.col("p_name"))).otherwise(F.lit("")).alias("content_hash"),
        F.when(kind == 4, "delete").otherwise("update").alias("kind"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: signup builds, view and click read, purchase and error change, keyed by user, in time order."""
    e = table(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "signup", "build").when(F.col("event_type").isin("view", "click"), "read").otherwise("change")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when((what == "change") & (k >= 95), "delete").otherwise(what)
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), (k % 7).alias("content"), "value", "props",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type",
    )
