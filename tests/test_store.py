"""Stores against a dictionary: batches, prefixes, compaction, races, writers that stop half-way, and readers meanwhile."""

import random
import threading

import pytest

from tidemark.sources import commits
from tidemark.sources.commits import CommitLog, State
from tidemark.sources.store import EphemeralStore, UnitStore


def units(spark, rows):
    return spark.createDataFrame(list(rows), "id string, query string")


def content(store):
    return {r["id"]: r["query"] for r in store.all().collect()}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/units"


def test_reopened_store_sees_what_follows_a_compaction(spark, path):
    store, other = UnitStore(spark, path), UnitStore(spark, path, prefix="other")
    store.put(units(spark, [("a", "1"), ("b", "1")]))
    other.put(units(spark, [("a", "x"), ("z", "x")]), batch_id=7)
    store.put(units(spark, [("b", "2")]))
    store.delete(["a"])
    order = [r["id"] for r in other.all().orderBy("place").collect()]
    assert store.compact()
    store.put(units(spark, [("c", "3")]))
    for s in (store, UnitStore(spark, path)):
        assert content(s) == {"b": "2", "c": "3"} and len(s) == 2
    again = UnitStore(spark, path, prefix="other")
    assert content(again) == {"a": "x", "z": "x"} and [r["id"] for r in again.all().orderBy("place").collect()] == order
    assert not again.put(units(spark, [("a", "y")]), batch_id=7) and content(again)["a"] == "x"  # batch ids outlive compaction
    assert again.get("z").first()["query"] == "x" and again.get("q").first() is None


def test_readers_keep_their_snapshot(spark, path):
    store = UnitStore(spark, path)
    store.put(units(spark, [("a", "1")]))
    store.put(units(spark, [("b", "1")]))
    before = store.all()
    writer = UnitStore(spark, path)
    assert writer.compact() and writer.put(units(spark, [("a", "2"), ("c", "2")]))
    assert {(r["id"], r["query"]) for r in before.collect()} == {("a", "1"), ("b", "1")}
    assert content(store) == {"a": "2", "b": "1", "c": "2"}
    assert store.vacuum(older_than_s=3600) == 0 and store.vacuum(older_than_s=0) == 2
    assert content(UnitStore(spark, path)) == {"a": "2", "b": "1", "c": "2"}


def test_a_batch_committed_during_a_compaction_stays(spark, path, monkeypatch):
    store, writer = UnitStore(spark, path), UnitStore(spark, path)
    store.put(units(spark, [("a", "1")]))
    commit = CommitLog.commit

    def late(log, entry):
        if log is store.commits:
            monkeypatch.setattr(CommitLog, "commit", commit)
            writer.put(units(spark, [("a", "2"), ("b", "2")]))
            assert writer.compact()
        return commit(log, entry)

    monkeypatch.setattr(CommitLog, "commit", late)
    assert not store.compact()  # the other compaction was first
    assert content(UnitStore(spark, path)) == {"a": "2", "b": "2"}
    writer.put(units(spark, [("c", "3")]))
    assert store.compact() and content(store) == {"a": "2", "b": "2", "c": "3"}


def test_a_writer_that_stops_before_its_commit(spark, path, monkeypatch):
    store = UnitStore(spark, path)
    store.put(units(spark, [("a", "1")]), batch_id=1)

    def stopped(log, entry):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", stopped)
        with pytest.raises(KeyboardInterrupt):
            store.put(units(spark, [("a", "2"), ("b", "2")]), batch_id=2)
    assert content(UnitStore(spark, path)) == {"a": "1"}
    again = UnitStore(spark, path)
    assert again.put(units(spark, [("a", "2"), ("b", "2")]), batch_id=2)
    assert not again.put(units(spark, [("a", "3")]), batch_id=2) and not store.put(units(spark, [("a", "3")]), batch_id=1)
    assert content(store) == {"a": "2", "b": "2"} and store.log().count() == 3
    assert store.vacuum(older_than_s=0) == 1 and content(store) == {"a": "2", "b": "2"}


def test_concurrent_writers(spark, path):
    """Two writers: every batch of either is there once, a batch id that both have is applied once."""
    done, failed = {0: [], 1: []}, []

    def work(k):
        try:
            store = UnitStore(spark, path)
            for i in range(5):
                assert store.put(units(spark, [(f"{k}-{i}", str(k))]))
                done[k].append(store.put(units(spark, [(f"shared-{i}", str(k))]), batch_id=i))
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in done]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    store = UnitStore(spark, path)
    assert [a + b for a, b in zip(done[0], done[1])] == [1] * 5
    want = {f"{k}-{i}": str(k) for k in done for i in range(5)} | {f"shared-{i}": str(0 if done[0][i] else 1) for i in range(5)}
    assert content(store) == want and store.log().count() == 15
    assert sorted(store.commits.state().live.values()) == list(range(1, 16))


@pytest.mark.parametrize("local", [True, False])
def test_a_name_is_created_once(spark, path, local):
    log = CommitLog(spark, path)
    assert log.local
    log.local = local
    assert log.create("x.json", {"a": 1}) and not log.create("x.json", {"a": 2})
    assert log._read("x.json") == {"a": 1}
    assert [f.getPath().getName() for f in log.fs.listStatus(log._file(""))] == ["x.json"]


def test_opening_reads_a_bounded_number_of_commits(spark, path, monkeypatch):
    monkeypatch.setattr(commits, "STATES", 4)
    log = CommitLog(spark, path)
    for i in range(10):
        assert log.commit({"prefix": "p", "batch": i if i % 3 else None, "add": [f"t{i}"], "gone": []}) == i + 1
    read, plain = [], CommitLog._read
    monkeypatch.setattr(CommitLog, "_read", lambda self, name: read.append(name) or plain(self, name))
    assert CommitLog(spark, path).state() == log.known and len(read) == 3  # the state after 8, and commits 9 and 10
    assert log.commit({"prefix": "p", "batch": 4, "add": ["again"], "gone": []}) is None
    assert log.commit({"prefix": "q", "batch": 4, "add": ["q"], "gone": []}) == 11
    assert log.commit({"prefix": "p", "batch": None, "add": [], "gone": ["nothing"]}) is None


def test_ranges_of_batches():
    random.seed(2)
    state, seen = State(), set()
    for version in range(1, 200):
        batch = random.randrange(60)
        assert state.has("p", batch) == (batch in seen) and not state.has("q", batch)
        state, seen = state.after(version, {"prefix": "p", "batch": batch, "add": [], "gone": []}), seen | {batch}
    assert all(b + 1 < c for (_, b), (c, _) in zip(state.applied["p"], state.applied["p"][1:]))


def test_stores_equal_a_dictionary(spark, path):
    random.seed(5)
    kept, passing, want = UnitStore(spark, path), EphemeralStore(spark), {}
    for step in range(8):
        puts = {random.choice("abcdef"): str(step) for _ in range(3)}
        gone = [x for x in random.sample("abcdef", 2) if x not in puts]
        for store in (kept, passing):
            assert store.write(units(spark, puts.items()), gone, batch_id=step)
            assert not store.write(units(spark, [("a", "twice")]), None, batch_id=step)
        want = {k: v for k, v in (want | puts).items() if k not in gone}
        if step == 4:
            kept.compact()
        assert content(kept) == content(passing) == want
    assert passing.get("nothing").count() == 0 and len(passing) == len(want) and EphemeralStore(spark).all().count() == 0


def test_units_are_parsed_once(spark):
    from tidemark.sources.store import decoded, from_json

    bodies = ['{"id": "a", "namespace": "n", "provenance": {"model_version": "m"}}', '{"id": "b"}', "{broken", None, '{"id": "c", "hits": 3, "provenance": {}}']
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    units = from_json(rows)
    assert sorted((r["id"], r["namespace"], r["query"], r["status"], r["hits"], r["evidence"]) for r in units.collect()) == [("a", "n", "", "fresh", 0, []), ("c", "", "", "fresh", 3, [])]
    assert units._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    single = rows.select(decoded(rows["body"]).alias("u")).collect()
    assert [r["u"] and r["u"]["id"] for r in single] == ["a", None, None, None, "c"]
