"""Sets against sequences: replay, stateful streams, change streams into a store, and small functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import embedders
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.functions.synthesis import Chunk
from tidemark.operators import freshness as R
from tidemark.operators import similarity
from tidemark.operators.provenance import until_evicted
from tidemark.operators.stats import calibrate, suggest
from tidemark.plans.engine import Engine, text_hash
from tidemark.sources.store import UnitStore
from tidemark.streaming.changes import stream_payloads
from tidemark.streaming.replay import replay, stream_replay

LOG = (
    "namespace string, seq bigint, kind string, query string, chunks array<struct<artifact_id:string,text:string,version:string>>, "
    "artifact_id string, content_hash string, version string, change_kind string"
)


def events(n=120):
    random.seed(1)
    words = ["leave", "policy", "remote", "payroll", "security"]
    rows = []
    for seq in range(n):
        ns = random.choice(["a", "b"])
        if random.random() < 0.7:
            query = " ".join(random.sample(words, 2))
            rows.append((ns, seq, "read", query, [(f"doc:{w}", f"text of {w}", "v1") for w in query.split()], None, None, None, None))
        else:
            w = random.choice(words)
            digest = random.choice([text_hash(f"text of {w}"), "0" * 16, ""])
            rows.append((ns, seq, "change", None, None, f"doc:{w}", digest, "v1", random.choice(["update", "update", "delete"])))
    return rows


def brute(rows):
    out = {}
    for ns in ("a", "b"):
        now = []
        e = Engine(lambda q, n: now, clock=lambda: 0.0)  # noqa: B023
        for r in (r for r in rows if r[0] == ns):
            if r[2] == "read":
                now = [Chunk(*c) for c in r[4]]
                x = e.get(r[3], ns, related=0)
                out[r[1]] = (x.unit_id, x.cache_hit)
            else:
                x = e.change(r[5], r[6], r[7], r[8])
                out[r[1]] = (x["matched_units"], len(x["dirtied"]))
    return out


def test_replay_equals_one_by_one(spark, tmp_path):
    rows = events()
    log = spark.createDataFrame(rows, LOG)
    pick = lambda r: (r["unit_id"], r["cache_hit"]) if r["kind"] == "read" else (r["matched_units"], r["dirtied"])
    assert {r["seq"]: pick(r) for r in replay(log).collect()} == brute(rows)
    log.orderBy("seq").coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = stream_replay(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"))
    q = stream.writeStream.format("memory").queryName("replayed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["seq"]: pick(r) for r in spark.table("replayed").collect()} == brute(rows)


def test_stream_replay_goes_on_after_a_restart(spark, tmp_path):
    """Triggers of 15 rows, each a run of its own from the checkpoint, equal the replay of the whole log."""
    rows, pick = events(90), lambda r: {k: v for k, v in r.asDict().items() if k != "confidence"}
    schema = spark.createDataFrame([], LOG).schema
    (tmp_path / "log").mkdir()
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    for first in range(0, len(rows), 15):
        spark.createDataFrame(rows[first : first + 15], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        q = stream_replay(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    got = sorted((pick(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r["seq"])
    assert got == sorted((pick(r) for r in replay(spark.createDataFrame(rows, LOG)).collect()), key=lambda r: r["seq"])


def test_a_trigger_writes_the_state_of_touched_units_only(spark, tmp_path):
    """300 units of one hot artifact and one of their own each; then a hit and an unknown source; then a change of one source."""
    words = [f"w{i}x" for i in range(300)]
    built = [("n", i, "read", f"{w} {w}q", [("doc:all", "text", "v1"), (f"doc:{w}", f"text of {w}", "v1")], None, None, None, None) for i, w in enumerate(words)]
    hit = [("n", 1000, "read", "w7x w7xq", [], None, None, None, None), ("n", 1001, "change", None, None, "doc:none", "x", "v2", "update")]
    change = [("n", 1002, "change", None, None, "doc:w9x", "0" * 16, "v2", "update")]
    everything = [("n", 1003, "change", None, None, "doc:all", "0" * 16, "v2", "update")]
    updated = []
    (tmp_path / "log").mkdir()
    source = spark.readStream.schema(spark.createDataFrame([], LOG).schema).parquet(f"{tmp_path}/log")
    for part in (built, hit, change, everything):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        q = stream_replay(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
    out = {r["seq"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    touched = [sum(r["cache_hit"] is False for r in out.values()), out[1000]["cache_hit"], out[1002]["dirtied"], out[1003]["dirtied"]]
    assert touched[0] > 290 and touched == [touched[0], True, 1, touched[0]]
    assert updated[1] == 1 and updated[2] == 1 and updated[3] == touched[0]


def test_payload_stream_reaches_the_store(spark, tmp_path):
    store = UnitStore(spark, f"file://{tmp_path}/units")
    span = lambda a: [{"artifact_id": a, "version": "v1", "span": None, "content_hash": text_hash(a)}]
    rows = [(i, "", a, {"model_version": "m", "prompt_version": "p", "source_spans": span(a), "observed_edges": ["x"]}, "fresh") for i, a in (("u1", "a"), ("u2", "b"), ("u3", "c"))]
    p = "struct<model_version:string,prompt_version:string,source_spans:array<struct<artifact_id:string,version:string,span:string,content_hash:string>>,observed_edges:array<string>>"
    store.put(spark.createDataFrame(rows, f"id string, namespace string, query string, provenance {p}, status string"))
    changes = [{"artifact_id": "a", "content_hash": text_hash("a")}, {"artifact_id": "b", "version": "v2"}, {"artifact_id": "c", "kind": "delete"}, {"artifact_id": "none"}]
    spark.createDataFrame([(1, "cdc", json.dumps({"changes": changes}))], "seq bigint, source string, payload string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq bigint, source string, payload string").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream_payloads(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
        assert {r["id"]: r["status"] for r in store.all().collect()} == {"u1": "fresh", "u2": "dirty"}
    store.compact()
    assert {r["id"]: r["status"] for r in store.all().collect()} == {"u1": "fresh", "u2": "dirty"}


def test_nothing_follows_an_eviction(spark):
    rows = [(1, "u", "dirty"), (2, "u", "evict"), (3, "u", "dirty"), (4, "u", "evict"), (3, "v", "skip")]
    left = until_evicted(spark.createDataFrame(rows, "event_seq bigint, unit string, action string"))
    assert sorted(map(tuple, left.collect())) == [(1, "u", "dirty"), (2, "u", "evict"), (3, "v", "skip")]


@pytest.mark.parametrize("namespaces", ["none", "equal", "visible"])
@pytest.mark.parametrize("groups", [False, True])
def test_similarity_equals_all_pairs(spark, monkeypatch, namespaces, groups):
    """Items broadcast, and streamed in several blocks against several parts of the queries; ties go to the smaller seq."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "a", "b"]), [float(rnd.randint(-1, 1)) for _ in range(3)]) for i in range(90)]
    items = spark.createDataFrame(rows, "seq bigint, ns string, vector array<double>").repartition(3)
    asked = items.withColumnRenamed("seq", "qid")
    sees = {"none": lambda a, b: True, "equal": lambda a, b: a == b, "visible": lambda a, b: a is None or b is None or a == b}[namespaces]
    want = {}
    for i, own, x in rows:
        found = [(-round(embedders.cosine(x, y), 9), j, ns) for j, ns, y in rows if i != j and sees(own, ns)]
        parts = [[f for f in found if f[2] == ns] for ns in (None, "a", "b")] if groups else [found]
        for p in parts:
            want |= {(i, j): (s * -1 + 0.0, r) for r, (s, j, _) in enumerate(sorted(p, key=lambda f: f[:2])[:4], 1)}
    for broadcast, block, held in ((similarity.BROADCAST_BYTES, 8192, 16_384), (0, 7, 11)):
        monkeypatch.setattr(similarity, "BROADCAST_BYTES", broadcast)
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "ASKED", held)
        got = similarity.similarity_topk(asked, items, 4, positive=False, namespaces=namespaces, not_itself=True, groups=groups).collect()
        assert {(r["qid"], r["seq"]): (r["score"], r["rank"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("broadcast, block, held", [(similarity.BROADCAST_BYTES, 8192, 16_384), (0, 7, 11)])
def test_pair_statistics_equal_all_pairs(spark, monkeypatch, broadcast, block, held):
    """Extremes by kind, and the score at every kind of place, from counts; a task gives classes, not pairs."""
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "ASKED", held)
    random.seed(8)
    rows = [(i, random.choice("ab"), [random.choice([-1.0, 0.0, 0.5, random.gauss(0, 1)]) for _ in range(3)]) for i in range(60)]
    items = spark.createDataFrame(rows, "seq bigint, ns string, vector array<double>").repartition(3)
    pairs = [(round(embedders.cosine(x, y), 9) + 0.0, p == q) for i, (_, p, x) in enumerate(rows) for _, q, y in rows[:i]]
    got = {r["same"]: (r["n"], r["low"], r["high"]) for r in similarity.pair_extremes(items).collect()}
    for same in (True, False):
        own = [s for s, kind in pairs if kind == same]
        assert got[same][0] == len(own) and got[same][1:] == pytest.approx((min(own), max(own)), abs=2e-9)
    scores = sorted(s for s, _ in pairs)
    for at in (0, 1, len(pairs) // 2, len(pairs) - 1):
        n, score = similarity.pair_at(items, lambda n, at=at: at)
        assert n == len(pairs) and score == pytest.approx(scores[at], abs=2e-9)
    rows_out = similarity._pairs(items, 9, lambda: lambda score=None, same=None: ([1], [2]) if score is None else None, "a bigint, b bigint")
    assert rows_out.count() == rows_out.rdd.getNumPartitions()


def test_token_buckets_equal_the_expressions(spark):
    random.seed(4)
    pool = "abs SXZ059\u0130\u212a\u00df\u00e9-.\n\x1c "
    texts = [None, "", "the THE this", "s ss sss ssss classes", "\u0130s \u212aelvins", *("".join(random.choice(pool) for _ in range(40)) for _ in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string").repartition(2)
    want = F.transform(T.tokens(F.col("t")), lambda t: T.bucket(t, 100))
    assert df.select(V.buckets(F.col("t"), 100).alias("got"), want.alias("want")).where("NOT got <=> want").count() == 0


def test_columns_equal_python(spark):
    texts = ["Policies of the class", "leave LEAVES", "", "Ünder 21 days, gives", "a1 b2 s ss sss ssss"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    rows = df.select("i", "t", T.tokens(F.col("t")).alias("k")).collect()
    assert all(r["k"] == embedders.matching_tokens(r["t"]) for r in rows)
    found = V.hashed_vectors(df, ["i", "t"], "t").collect()
    assert all(max(map(abs, (a - b for a, b in zip(r["vector"], embedders.HashingEmbedder().embed(r["t"]))))) < 1e-12 for r in found)
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in pair.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 4 / (5**0.5 * 30**0.5)) < 1e-12 and got[1] == 0.0


def test_thresholds_and_as_of(spark):
    none = spark.createDataFrame([], "seq bigint, ns string, vector array<double>")
    assert tuple(suggest(none).first()) == (0.45, 0.4) and tuple(calibrate(similarity.pair_extremes(none)).first()) == (0.3, 0.25)
    three = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0]), (1, "a", [0.0, 1.0, 0.0]), (2, "b", [0.0, 0.0, 1.0])], none.schema)
    assert tuple(suggest(three).first()) == (0.08, 0.03)
    log = [("k", 1, "read", None), ("k", 2, "build", 5), ("k", 3, "change", 5), ("k", 4, "read", None), ("k", 5, "change", 6), ("k", 6, "read", None), ("k", 7, "delete", None), ("k", 8, "read", None), ("k", 9, "build", 6), ("k", 10, "read", None)]
    found = R.as_of(spark.createDataFrame(log, "key string, seq bigint, kind string, content int")).orderBy("seq").collect()
    assert [r["state"] for r in found] == ["unbuilt", "fresh", "stale", "evicted", "fresh"]
