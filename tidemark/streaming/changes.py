"""Change streams: payloads or events as they come, applied batch by batch, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import provenance as O
from ..plans.cache import apply_changes
from ..sources.connectors import events_of, numbered
from ..sources.store import UnitStore


def stream_actions(changes: DataFrame, spans: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append (event_seq, unit, action) of a stream of change events to ``out``; a batch writes a folder of its own, so a retry replaces it."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        O.change_actions(batch, spans).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_payloads(payloads: DataFrame, store: UnitStore, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Webhook payloads (seq, source, payload) to the units of a store; the store leaves out a batch that it has."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        events = numbered(events_of(batch)).select("event_seq", "artifact_id", "version", F.col("content_hash"), "kind")
        actions = apply_changes(store, events, batch_id + 1)
        if done:
            done(actions, batch_id)

    return payloads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a ``Landing`` writes.
LANDED = "name string, source string, payload string"


def stream_landed(
    spark: SparkSession, folder: str, store: UnitStore, checkpoint: str, files: int = 10_000, done: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """The payloads that a ``Landing`` keeps landing in ``folder`` to the units of a store, once each, in the order of their names.

    A trigger takes ``files`` payloads at most, which bounds what is numbered in one task.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.withColumn("seq", F.row_number().over(Window.orderBy("name")).cast("bigint"))
        events = numbered(events_of(ordered)).select("event_seq", "artifact_id", "version", "content_hash", "kind")
        actions = apply_changes(store, events, batch_id + 1)
        if done:
            done(actions, batch_id)

    landed = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(folder)
    return landed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
