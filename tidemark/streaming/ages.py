"""Age limits by timers: units expire without a read, as event time passes.

A stream of builds and checks (unit, fresh_at) is keyed by unit; the state of a unit is when it was last fresh
and one timer, which a later build or check moves. Past its limit a unit is emitted once, as dirty as of the
moment it expired; it stays forgotten until it is fresh again. So what a stream marks until some time is what
a read at that time would find expired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.store import Store

EXPIRED = "unit string, fresh_at timestamp, expired_at timestamp"


def _ages(max_age_ms: int) -> StatefulProcessor:
    """The processor; it refers to nothing of this package, as the driver's helper process doesn't have it."""

    class Ages(StatefulProcessor):
        def init(self, handle: Any) -> None:
            self.handle = handle
            self.fresh = handle.getValueState("fresh", "at long, due long")

        def _watch(self, at: int) -> None:
            """A timer at the first millisecond past the limit; the one before it goes."""
            if self.fresh.exists():
                known, due = self.fresh.get()
                if known >= at:
                    return
                self.handle.deleteTimer(due)
            due = at + max_age_ms + 1
            self.fresh.update((at, due))
            self.handle.registerTimer(due)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self._watch(max(int(part["fresh_ms"].max()) for part in rows))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if not self.fresh.exists():
                return
            at, due = self.fresh.get()
            if expiredTimerInfo.getExpiryTimeInMs() != due:  # of a time that has been moved
                return
            self.fresh.clear()
            when = pd.to_datetime([at, due], unit="ms")
            yield pd.DataFrame({"unit": [key[0]], "fresh_at": when[:1], "expired_at": when[1:]})

        def close(self) -> None:
            pass

    return Ages()


def expirations(fresh: DataFrame, max_age: float, late: str = "0 seconds") -> DataFrame:
    """(unit, fresh_at, expired_at) of a stream (unit, fresh_at timestamp), each unit once whenever ``max_age`` seconds pass.

    Times are whole milliseconds. Event time moves with the newest ``fresh_at`` of all units, less ``late``. The
    session's state store must be the RocksDB one.
    """
    rows = fresh.select("unit", F.col("fresh_at").cast("timestamp").alias("fresh_at"), F.unix_millis(F.col("fresh_at").cast("timestamp")).alias("fresh_ms"))
    keyed = rows.withWatermark("fresh_at", late).groupBy("unit")
    return keyed.transformWithStateInPandas(_ages(round(max_age * 1000)), EXPIRED, "Append", "EventTime")


def stream_expirations(fresh: DataFrame, store: Store, max_age: float, checkpoint: str, late: str = "0 seconds", done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Mark units of a store dirty as they expire; one that was refreshed there since is left alone. A batch is one commit."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(F.col("unit").alias("id")).agg(F.max(F.unix_millis("fresh_at")).alias("_ms"))
        units = store.all().join(last, "id").where((F.col("status") == "fresh") & (F.round(F.col("freshness_epoch") * 1000).cast("long") <= F.col("_ms")))
        store.write(units.withColumn("seq", F.col("place.first_seq")).withColumn("status", F.lit("dirty")).drop("place", "_ms"), None, batch_id)
        if done:
            done(batch, batch_id)

    out = expirations(fresh, max_age, late)
    return out.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
