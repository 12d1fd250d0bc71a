"""The mechanism benchmark: freshness and cost of three ways to answer repeated questions over changing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embedders import HashingEmbedder, cosine
from ..functions.synthesis import Chunk
from ..operators import provenance as O
from .engine import Engine, Settings, text_hash

#: Topics, and the version that a topic's source moves to halfway.
TOPICS = ("leave", "remote", "security", "payroll", "expenses")
MOVED = {"leave": 1, "security": 1}


def document(topic: str, version: int) -> str:
    return f"the {topic} policy allowance is currently mk{topic}{version}"


def observations() -> list[tuple[str, str, int, str, int]]:
    """(system, topic, current version, context, tokens paid) of each read, systems naive, no_invalidation and cache."""
    out = []
    for system in ("naive", "no_invalidation", "cache"):
        corpus = {f"policy:{t}": document(t, 0) for t in TOPICS}
        embedder = HashingEmbedder()

        def nearest(query: str, _: str | None, corpus=corpus, embedder=embedder) -> list[Chunk]:
            q = embedder.embed(query)
            scored = [(cosine(q, embedder.embed(text)), a, text) for a, text in corpus.items()]
            top = max((x for x in scored if x[0] > 0), key=lambda x: x[0], default=None)
            return [Chunk(top[1], top[2], "v1")] if top else []

        engine = Engine(nearest, settings=Settings(coverage_floor=0.0))
        current = dict.fromkeys(TOPICS, 0)
        for phase in (0, 1):
            if phase:
                for topic, version in MOVED.items():
                    current[topic], corpus[f"policy:{topic}"] = version, document(topic, version)
                    if system == "cache":
                        engine.change(f"policy:{topic}", text_hash(document(topic, version)))
            for topic in TOPICS:
                if system == "naive":
                    chunks = nearest(f"{topic} policy", None)
                    text, paid = " ".join(c.text for c in chunks), True
                else:
                    found = engine.get(f"{topic} policy")
                    text, paid = " ".join(c.text for c in found.evidence), not found.cache_hit
                out.append((system, topic, current[topic], text, len(text.split()) if paid else 0))
    return out


def report(rows: DataFrame) -> DataFrame:
    """Reads, correct and stale ones, cost and rates of each system: correct has the current marker, stale another one only."""
    marker = lambda v: F.concat(F.lit("mk"), "topic", v.cast("string"))
    right = F.contains("context", marker(F.col("version")))
    other = F.exists(F.array(*map(F.lit, range(5))), lambda v: (v != F.col("version")) & F.contains("context", marker(v)))
    per = rows.groupBy("system").agg(
        F.count("*").alias("reads"), F.count_if(right).alias("correct"), F.count_if(~right & other).alias("stale"), F.sum("tokens").alias("cost_tokens")
    )
    return per.select("*", (F.col("correct") / F.col("reads")).alias("accuracy"), (F.col("stale") / F.col("reads")).alias("stale_rate"))


def run_benchmark(spark: SparkSession) -> DataFrame:
    return report(spark.createDataFrame(observations(), "system string, topic string, version int, context string, tokens bigint"))


#: Of this many sources in turn, the first ones change between the two rounds of reads.
EVERY, CHANGE = 5, 2


def two_rounds(documents: DataFrame) -> DataFrame:
    """(artifact_id, old, new): each document's text in the first and the second round; some change, and some are only said to."""
    old = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), "doc_id").alias("artifact_id"), old.alias("old"),
        F.when(F.pmod("doc_id", F.lit(EVERY)) < CHANGE, F.concat(old, F.lit(" as amended"))).otherwise(old).alias("new"),
    )


def table_benchmark(documents: DataFrame) -> DataFrame:
    """The benchmark over a table: every document is read twice, and between the two every source reports a change.

    The naive system pays for each read; without invalidation the first text is served again; the cache follows
    the change events, of which those with the hash that a unit has don't concern it. All reads of a round are
    answered at once.
    """
    rounds = two_rounds(documents)
    texts = rounds.select(
        "seq", "artifact_id", T.content_hash(F.col("old")).alias("old_hash"), T.content_hash(F.col("new")).alias("new_hash"),
        T.token_count(F.col("old")).cast("bigint").alias("old_cost"), T.token_count(F.col("new")).cast("bigint").alias("new_cost"),
    )
    spans = texts.select(F.col("artifact_id").alias("unit"), "artifact_id", F.lit("v1").alias("version"), F.col("old_hash").alias("content_hash"))
    changes = texts.select(F.col("seq").alias("event_seq"), "artifact_id", F.lit("").alias("version"), F.col("new_hash").alias("content_hash"), F.lit("update").alias("kind"))
    ends = O.fold_actions(O.change_actions(changes, spans)).select(F.col("unit").alias("artifact_id"), (F.col("outcome") == "dirty").alias("dirty"))
    both = texts.join(ends, "artifact_id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    read = lambda system, served, current, paid: F.struct(F.lit(system).alias("system"), served.alias("served"), current.alias("current"), paid.alias("paid"))
    old, new, free = F.col("old_hash"), F.col("new_hash"), F.lit(0).cast("bigint")
    first = [read(s, old, old, F.col("old_cost")) for s in ("naive", "no_invalidation", "cache")]
    second = [
        read("naive", new, new, F.col("new_cost")), read("no_invalidation", old, new, free),
        read("cache", F.when(F.col("dirty"), new).otherwise(old), new, F.when(F.col("dirty"), F.col("new_cost")).otherwise(free)),
    ]
    reads = both.select(F.explode(F.array(*first, *second)).alias("r")).select("r.*")
    per = reads.groupBy("system").agg(
        F.count("*").alias("reads"), F.count_if(F.col("served") == F.col("current")).alias("correct"),
        F.count_if(F.col("served") != F.col("current")).alias("stale"), F.sum("paid").alias("cost_tokens"),
    )
    return per.select("*", (F.col("correct") / F.col("reads")).alias("accuracy"), (F.col("stale") / F.col("reads")).alias("stale_rate"))
