"""Timers against lazy expiry: what has expired by the time of each trigger is what a read then would find."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.freshness import expired
from tidemark.sources.store import UnitStore
from tidemark.streaming.ages import expirations, stream_expirations

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "unit string, fresh_at timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def lazy(seen, now, max_age):
    """Units that a read at ``now`` finds past their age, with when they were fresh."""
    last = {}
    for unit, second in seen:
        last[unit] = max(second, last.get(unit, second))
    return {(u, s) for u, s in last.items() if now - s > max_age}


def test_units_expire_as_a_read_would_find_them(spark, tmp_path):
    """Runs of a stream, restarted each time; every unit that is due is emitted once until it is fresh again."""
    random.seed(3)
    (tmp_path / "in").mkdir()
    seen, emitted, clock, marked = [], [], 0, set()
    source = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    for step in range(4):
        new = [(random.choice("abcdef"), clock + random.randrange(20)) for _ in range(6)] + [("clock", clock + 20)]
        clock += 20
        seen += new
        spark.createDataFrame([(u, at(s)) for u, s in new], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = expirations(source, 25).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out").select("unit", F.unix_millis("fresh_at").alias("ms"), F.unix_millis("expired_at").alias("due")).collect()
        emitted = [(r["unit"], r["ms"] // 1000 - int(START.timestamp())) for r in found]
        assert len(emitted) == len(set(emitted)) and all(r["due"] == r["ms"] + 25_001 for r in found)
        marked |= lazy(seen, clock, 25)  # what reads at the end of each run would have found
        assert set(emitted) == marked
    assert marked
    ages = spark.createDataFrame([(float(s), float(n)) for s, n in ((0, 25), (0, 26))], "e double, n double")
    assert [r[0] for r in ages.select(expired(F.col("e"), F.col("n"), 25.0)).collect()] == [False, True]  # the lazy rule


def test_units_of_a_store_become_dirty_without_a_read(spark, tmp_path):
    epoch = START.timestamp()
    store = UnitStore(spark, f"file://{tmp_path}/units")
    units = [("a", "fresh", epoch), ("b", "fresh", epoch), ("c", "fresh", epoch + 15), ("d", "dirty", epoch)]
    store.put(spark.createDataFrame(units, "id string, status string, freshness_epoch double"))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")

    def run(*rows):
        spark.createDataFrame([(u, at(s)) for u, s in rows], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_expirations(source, store, 10, f"{tmp_path}/check", late="15 seconds").awaitTermination()
        return {r["id"]: r["status"] for r in UnitStore(spark, f"file://{tmp_path}/units").all().collect()}

    # b was refreshed in the store at 16, which this stream hasn't heard of.
    store.put(spark.createDataFrame([("b", "fresh", epoch + 16)], "id string, status string, freshness_epoch double"))
    assert run(("a", 0), ("b", 0), ("c", 15), ("d", 0), ("x", 30)) == {"a": "dirty", "b": "fresh", "c": "fresh", "d": "dirty"}
    assert run(("b", 16), ("x", 41)) == {"a": "dirty", "b": "fresh", "c": "dirty", "d": "dirty"}
    assert run(("x", 42)) == {"a": "dirty", "b": "dirty", "c": "dirty", "d": "dirty"}
