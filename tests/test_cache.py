"""Behaviour of reads, changes, freshness, stores, tools and commands."""

import json
import random

import pytest

from tidemark import cli
from tidemark.functions.embedders import FunctionEmbedder, HashingEmbedder, cosine
from tidemark.functions.synthesis import JSONPassthrough, ModelSynthesizer, StubProvider
from tidemark.integrations import graph_node, receive_webhook, tools
from tidemark.plans.cache import ContextCache
from tidemark.plans.engine import Engine, Settings, Unit, make_id
from tidemark.sources import connectors as C
from tidemark.sources.retrievers import ChromaRetriever, Composite, FunctionRetriever, MemoryCorpus, QdrantRetriever, chroma_rows
from tidemark.sources.store import UnitStore

DOCS = {"leave.md": "Employees accrue 21 days of annual leave.", "hr.md": "The HR team owns every policy and the overview."}


def source(texts):
    def run(query, namespace):
        e = HashingEmbedder()
        scored = [(cosine(e.embed(query), e.embed(t)), a, t) for a, t in texts.items()]
        return [(a, t, "v1") for s, a, t in sorted(scored, key=lambda x: -x[0]) if s > 0]

    return run


def test_second_read_hits_and_changes_rebuild(spark):
    texts = dict(DOCS)
    cache = ContextCache(spark, source(texts))
    first = cache.get("annual leave policy")
    again = cache.get("annual leave policy")
    assert (first.cache_hit, again.cache_hit, again.unit_id) == (False, True, first.unit_id)
    assert cache.source_changed("leave.md", text=texts["leave.md"])["skipped_unchanged"] == [first.unit_id]
    texts["leave.md"] = "Employees accrue 25 days of annual leave."
    assert cache.source_changed("leave.md", text=texts["leave.md"])["dirtied"] == [first.unit_id]
    rebuilt = cache.get("annual leave policy")
    assert not rebuilt.cache_hit and rebuilt.unit_id == first.unit_id and "25 days" in rebuilt.raw_text
    assert cache.source_deleted("leave.md")["deleted"] == [first.unit_id]
    assert cache.invalidate("nothing")["matched_units"] == 0
    assert cache.stats()["units"] == 0 and cache.drill(first.unit_id) == []


def test_age_and_revalidation(spark):
    now, content = [100.0], dict(DOCS)
    settings = Settings(max_age=10, revalidate=content.get)
    cache = ContextCache(spark, source(content), settings=settings, clock=lambda: now[0])
    cache.get("annual leave policy")
    now[0] = 110.0
    assert cache.get("annual leave policy").cache_hit
    now[0] = 125.0
    assert cache.get("annual leave policy").cache_hit  # looked up, unchanged
    now[0], content["leave.md"] = 150.0, "Employees accrue 30 days of annual leave."
    assert not cache.get("annual leave policy").cache_hit


def test_strategies_projection_and_escalation(spark):
    reply = json.dumps({"summary": "leave", "claims": ["annual leave is 21 days", "parking costs money"], "facts": {"leave": 21, "parking": 5}, "used": [0, True, 9]})
    synth = ModelSynthesizer(StubProvider(reply), "m")
    cache = ContextCache(spark, source(DOCS), synth, settings=Settings(hit_threshold=0.1, coverage_floor=0.99))
    cold = cache.get("annual leave")
    assert cold.context["understanding"]["claims"] == ["annual leave is 21 days"] and cold.context["raw"] == []
    hit = cache.get("leave allowance")
    assert hit.cache_hit and hit.escalated and hit.context["raw"]
    assert not cache.get("leave allowance", strategy="context_only").context["raw"]
    assert len(cache.engine.units[cold.unit_id].spans) == 1


def test_failed_and_uncited_synthesis(spark):
    cache = ContextCache(spark, source(DOCS), ModelSynthesizer(StubProvider("no json"), "m"))
    r = cache.get("annual leave policy")
    assert r.understanding == {"_synthesis_failed": True} and r.coverage == 1.0 and len(r.evidence) == 2
    cache = ContextCache(spark, source(DOCS), ModelSynthesizer(StubProvider(), "m"))
    assert cache.get("annual leave policy").understanding["_citation_fallback"]


def test_related_units(spark):
    said = {"a b": ["Leave "], "c d": ["leave"], "e f": ["other"]}

    class Synth:
        def synthesize(self, query, chunks):
            from tidemark.functions.synthesis import Synthesis

            return Synthesis({"summary": query, "entities": said[query]}, [0])

    axes = {"a b": [1, 0, 0], "c d": [0, 1, 0], "e f": [0, 0, 1]}
    cache = ContextCache(spark, lambda q, ns: [(f"doc:{q}", q, "v1")], Synth(), embedder=FunctionEmbedder(lambda t: axes.get(t.split("  ")[0], [0, 0, 0])))
    for q in said:
        cache.get(q)
    found = cache.get("c d").related
    assert [(r["unit_id"], r["relation"]) for r in found] == [(make_id("", "a b"), "shared_entity")]
    assert cache.get("c d", related=0).related == []


def test_store_keeps_units_over_restarts_and_commands(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/units"
    store = UnitStore(spark, path)
    cache = ContextCache(spark, source(DOCS), store=store)
    unit = cache.get("annual leave policy").unit_id
    assert ContextCache(spark, source(DOCS), store=UnitStore(spark, path)).get("annual leave policy").cache_hit
    assert len(UnitStore(spark, path, prefix="other")) == 0
    run = lambda *a: cli.main(["--db", path, *a], spark)
    assert run("ls") == 0 and unit in capsys.readouterr().out
    assert run("show", unit, "--json") == 0 and json.loads(capsys.readouterr().out)["status"] == "fresh"
    assert run("show", "none") == 1 and run("dirty", "none") == 1 and run("dirty", unit) == 0
    assert run("invalidate", "leave.md") == 0
    assert run("stats") == 0 and "dirty: 1" in capsys.readouterr().out
    assert run("purge") == 1 and run("evict", unit) == 0 and run("evict", unit) == 1
    assert len(store) == 0 and run("purge", "--yes") == 0


def test_passthrough_keeps_all_fields(spark):
    made = JSONPassthrough().synthesize("q", [type("C", (), {"text": t})() for t in ('{"k": 1}', "plain", '{"k": 2, "m": 3}', "null")])
    assert made.understanding["facts"] == {"k": 2, "m": 3} and made.understanding["claims"] == ["plain", None]
    assert len(JSONPassthrough(merge=False).synthesize("q", [type("C", (), {"text": '{"k": 1}'})()]).understanding["claims"]) == 1


def test_sources(spark):
    asked = spark.createDataFrame([(1, "annual leave", None), (2, "annual leave", "acme")], "qid bigint, query string, namespace string")
    corpus = MemoryCorpus(spark)
    corpus.add("a", "annual leave rules", namespace="acme")
    corpus.add("b", "leave of others", namespace="other")
    corpus.add("b", "annual leave rules for all")
    got = sorted((r["qid"], r["artifact_id"]) for r in corpus.retrieve(asked).collect())
    assert got == [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b")]
    same = FunctionRetriever(lambda q, ns: [("a", "annual leave rules", "v9"), ("", "dropped", "")])

    def broken(q, ns):
        raise RuntimeError("down")

    said = []
    both = Composite([same, FunctionRetriever(broken), corpus], said.append).retrieve(asked)
    rows = [(r["qid"], r["pos"], r["artifact_id"], r["version"]) for r in both.orderBy("qid", "pos").collect()]
    assert rows[0] == (1, 0, "a", "v9") and len(said) == 1 and "down" in said[0]
    with pytest.raises(ValueError):
        QdrantRetriever()
    hits = QdrantRetriever(search=lambda q, ns: [{"payload": {"artifact_id": "x", "text": "t"}}]).retrieve(asked).collect()
    assert {(r["artifact_id"], r["version"]) for r in hits} == {("x", "")}
    assert chroma_rows({"ids": [["1", "2"]], "documents": [["a", "b"]], "metadatas": [[{"version": "v"}]]}) == [("1", "a", {"version": "v"}), ("2", "b", {})]
    assert ChromaRetriever(lambda: None).to_chunk(("1", "a", {})) == ("1", "a", "")


def test_dispatch_and_signatures(spark):
    body = json.dumps({"after": "s1", "commits": [{"added": ["b"], "removed": ["a"]}], "pull_request": {"files": ["c", {"filename": "d"}]}})
    good = C.signature("k", body.encode())
    rows = lambda s, sig: spark.createDataFrame([(1, s, body, sig)], "seq bigint, source string, payload string, signature string")
    d = C.Dispatcher()
    assert [r["artifact_id"] for r in d.dispatch(rows("github", good), "k").orderBy("pos").collect()] == ["github:a", "github:b", "github:c", "github:d"]
    with pytest.raises(PermissionError):
        d.dispatch(rows("github", "sha256=0"), "k")
    with pytest.raises(C.UnknownSource):
        d.dispatch(rows("gitlab", None))
    assert not C.verify_signature("k", b"x", None)


def test_webhook_replies(spark):
    d = C.Dispatcher()
    body = json.dumps({"changes": [{"artifact_id": "a"}, {"artifact_id": "b", "kind": "delete"}]}).encode()
    assert receive_webhook(d, "cdc", body) == (200, {"accepted": 2})
    assert receive_webhook(d, "cdc", b"{")[0] == 400 and receive_webhook(d, "cdc", b"\xff")[0] == 400 and receive_webhook(d, "cdc", b"")[0] == 400
    assert receive_webhook(d, "gitlab", body)[0] == 404
    assert receive_webhook(d, "github", b"{}", "sha256=0", "k")[0] == 401
    assert receive_webhook(d, "github", b"{}", C.signature("k", b"{}"), "k") == (200, {"accepted": 0})


def test_changes_of_one_batch_are_one_write(spark, tmp_path):
    store = UnitStore(spark, f"file://{tmp_path}/units", prefix="all/of*[them]?")
    cache = ContextCache(spark, source(DOCS), store=store)
    unit = cache.get("annual leave policy").unit_id
    before = store.log().count()
    events = [(0, 0, "leave.md", "v2", "", "update"), (0, 1, "none", "", "", "update"), (1, 0, "leave.md", "", "", "delete"), (2, 0, "leave.md", "v3", "", "update")]
    out = cache.apply_changes(spark.createDataFrame(events, "seq bigint, pos int, artifact_id string, version string, content_hash string, kind string"))
    assert [(x["dirtied"], x["deleted"], x["matched_units"]) for x in out] == [([unit], [], 1), ([], [], 0), ([], [unit], 1), ([], [], 0)]
    assert store.log().count() == before + 1 and len(store) == 0


def plain_best(engine, q, namespace):
    scored = [(engine.score(q, u), -i, u) for i, u in enumerate(engine.units.values()) if u.namespace == namespace]
    top = max(scored, key=lambda x: x[:2], default=(-1.0, 0, None))
    return (top[2], top[0]) if top[0] > -1 else (None, -1.0)


@pytest.mark.parametrize("by_claim", [False, True])
def test_indexes_of_the_engine_equal_plain_scans(by_claim):
    """Units come, change and go; vectors are of several lengths, some zero, many equal."""
    rnd = random.Random(7)
    vector = lambda: [float(rnd.randint(-1, 2)) for _ in range(rnd.choice([0, 2, 3, 5]))]
    engine = Engine(lambda q, ns: [], settings=Settings(route_by_claim=by_claim))
    for step in range(400):
        ns = rnd.choice(["", "a"])
        if rnd.random() < 0.25:
            artifact = f"s{rnd.randint(0, 9)}"
            holding = [u.id for u in engine.units.values() if artifact in u.artifacts()]
            found = engine.change(artifact, version="v2", kind=rnd.choice(["update", "delete"]))
            assert found["dirtied"] + found["deleted"] == holding
        else:
            name = f"{ns}{rnd.randint(0, 30)}"
            spans = [{"artifact_id": f"s{rnd.randint(0, 9)}", "version": "v1", "span": None, "content_hash": ""} for _ in range(rnd.randint(0, 3))]
            said = {"entities": [f"E{rnd.randint(0, 5)} " for _ in range(rnd.randint(0, 2))]}
            engine.add(Unit(name, ns, name, vector(), said, [], spans, [], vector(), [vector() for _ in range(rnd.randint(0, 3))]))
        q = vector()
        assert engine.best(q, ns) == plain_best(engine, q, ns)
        for u in list(engine.units.values())[:3]:
            others = [o for o in engine.units.values() if o is not u and o.status == "fresh" and o.namespace == u.namespace]
            near = [o for o in others if u.entities() & o.entities() or set(u.artifacts()) & set(o.artifacts())]
            assert [r["unit_id"] for r in engine.related(u, q, 99)] == [o.id for o in sorted(near, key=lambda o: -engine.score(q, o))]
        assert engine.stats()["tracked_artifacts"] == len({a for u in engine.units.values() for a in u.artifacts()})


def test_node_and_tool(spark):
    cache = ContextCache(spark, lambda q, ns: [("b", "annual leave policy", "v1"), ("a", "annual leave", "v1"), ("b", "leave policy", "v1")])
    assert graph_node(cache)({"question": "annual leave policy"})["context"]["understanding"]["summary"]
    assert set(graph_node(cache)({})) == {"context"}
    (tool,) = tools(cache)
    said = tool.handler("annual leave policy")
    assert said["cache_hit"] and said["sources"] == ["b", "a", "b"]


def test_reads_that_ask_for_no_related_units_score_none(monkeypatch):
    from tidemark.functions.synthesis import Chunk
    from tidemark.plans.engine import Engine

    engine, scored = Engine(lambda query, ns: [Chunk("doc", "a common source", "v1")]), []
    plain = engine.score
    monkeypatch.setattr(engine, "score", lambda q, u: scored.append(u.id) or plain(q, u))
    texts = [f"alpha{i} beta{i} gamma{i}" for i in range(30)]
    for text in texts:
        engine.get(text, related=0)
    few = len(scored)
    assert len(engine.get(texts[0], related=2).related) == 2
    assert len(scored) - few >= 29  # with related units all that share the source are scored
    scored.clear()
    assert engine.get(texts[0], related=0).related == [] and len(scored) < 5


def test_vectors_of_slots_equal_brute_force():
    import numpy as np

    from tidemark.plans.engine import _Vectors

    rng = np.random.default_rng(2)
    for most in (1, 3):
        kept, have = _Vectors(), {}
        for step in range(60):
            slot = int(rng.integers(0, 20))
            have[slot] = [rng.normal(size=int(rng.integers(1, 40))) for _ in range(int(rng.integers(0, most + 1)))]
            kept.put(slot, have[slot])
        q = rng.normal(size=32)
        for asked in (q, np.where(np.arange(32) % 9 == 0, q, 0), np.zeros(32)):
            cos = lambda v, asked=asked: float(asked[: len(v)] @ v[:32]) / np.sqrt(v @ v)
            want = [max(map(cos, have.get(s, [])), default=-np.inf) for s in range(20)]
            assert np.allclose(kept.best(asked, 20), want)
