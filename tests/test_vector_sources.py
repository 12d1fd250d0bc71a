"""Vector databases through fake clients: searches with namespaces, and whole collections as Spark data sources."""

import sys
import types

import pytest
from pyspark import cloudpickle

from tidemark.sources import datasources
from tidemark.sources.retrievers import ChromaRetriever, PgVectorRetriever, QdrantRetriever

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests
#: (id, text, version, namespace, vector); the fifth has no id.
POINTS = [("a", "ta", "v1", "x", [1.0, 0.0]), ("b", "tb", None, "y", [0.0, 1.0]), ("c", None, "v2", "x", None), ("d", "td", "v1", None, [1.0]), (None, "te", "v1", "x", [0.5])]
EVERY = {("a", "ta", "v1", "x", (1.0, 0.0)), ("b", "tb", "", "y", (0.0, 1.0)), ("c", "", "v2", "x", None), ("d", "td", "v1", None, (1.0,))}


def payload(p):
    return {k: v for k, v in zip(("artifact_id", "text", "version", "namespace"), p) if v is not None}


class FakeQdrant:
    """The client's calls over POINTS; filters are (field, value)."""

    def point(self, p):
        return types.SimpleNamespace(payload=payload(p), vector=p[4])

    def kept(self, where):
        return [p for p in POINTS if where is None or payload(p).get(where[0]) == where[1]]

    def query_points(self, collection_name, query, limit, query_filter, with_payload):
        return types.SimpleNamespace(points=[self.point(p) for p in self.kept(query_filter)][:limit])

    def scroll(self, collection_name, scroll_filter, limit, offset, with_payload, with_vectors):
        kept, at = self.kept(scroll_filter), offset or 0
        return [self.point(p) for p in kept[at : at + limit]], at + limit if at + limit < len(kept) else None


class OldQdrant(FakeQdrant):
    query_points = property()

    def search(self, collection_name, query_vector, limit, query_filter, with_payload):
        return [self.point(p) for p in self.kept(query_filter)][:limit]


class FakeChroma:
    def kept(self, where):
        return [p for p in POINTS if where is None or p[3] == where["namespace"]]

    def count(self):
        return len(POINTS)

    def query(self, n_results, query_texts=None, query_embeddings=None, where=None):
        kept = self.kept(where)[:n_results]
        return {"ids": [[p[0] or "" for p in kept]], "documents": [[p[1] for p in kept]], "metadatas": [[payload(p) for p in kept]]}

    def get(self, limit, offset, include, where=None):
        kept = self.kept(where)[offset : offset + limit]
        return {"ids": [p[0] or "" for p in kept], "documents": [p[1] for p in kept], "metadatas": [payload(p) for p in kept], "embeddings": [p[4] for p in kept]}


class FakePg:
    """A connection whose cursor knows the two shapes of SQL."""

    def cursor(self):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *e):
        return False

    def execute(self, sql, how):
        how = list(how)
        if "<=>" in sql:
            ns = how.pop(0) if "WHERE namespace = %s" in sql else None
            self.found = [p[:3] for p in POINTS if ns is None or p[3] == ns][: how[-1]]
        else:
            parts, number, *wanted = how
            assert ("= ANY(%s)" in sql) == bool(wanted)
            self.found = [p for i, p in enumerate(POINTS) if i % parts == number and (not wanted or p[3] in wanted[0])]

    def fetchall(self):
        return self.found

    def fetchmany(self, n):
        out, self.found = self.found[:n], self.found[n:]
        return out


def pair(field, value):
    return (field, value)


RETRIEVERS = {
    "qdrant": lambda **k: QdrantRetriever(FakeQdrant, "c", lambda q: [1.0], make_filter=pair, **k),
    "old qdrant": lambda **k: QdrantRetriever(lambda: types.SimpleNamespace(search=OldQdrant().search), "c", lambda q: [1.0], make_filter=pair, **k),
    "chroma": lambda **k: ChromaRetriever(FakeChroma, lambda q: [1.0], **k),
    "pgvector": lambda **k: PgVectorRetriever(FakePg, "t", lambda q: [1.0], **k),
}


@pytest.mark.parametrize("kind", RETRIEVERS)
def test_searches_keep_to_their_namespace(spark, kind):
    asked = spark.createDataFrame([(1, "q", None), (2, "q", "x"), (3, "q", "y"), (4, "q", "nobody"), (5, "q", "")], "qid bigint, query string, namespace string")
    got = {}
    for r in RETRIEVERS[kind]().retrieve(asked).collect():
        got.setdefault(r["qid"], set()).add((r["artifact_id"], r["text"], r["version"]))
    every = {x[:3] for x in EVERY}
    in_ns = {n: {x[:3] for x in EVERY if x[3] == n} for n in ("x", "y")}
    assert got == {1: every, 2: in_ns["x"], 3: in_ns["y"], 5: every}
    assert RETRIEVERS[kind](k=1).retrieve(asked.where("qid = 1")).count() == 1


def test_a_namespace_that_cannot_be_applied_is_refused(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "q", "x")], "qid bigint, query string, namespace string")
    with pytest.raises(Exception, match="no namespaces"):
        PgVectorRetriever(FakePg, "t", lambda q: [1.0], namespace_column=None).retrieve(asked).collect()
    with pytest.raises(Exception, match="qdrant_client"):  # the client's own filters, which aren't installed here
        QdrantRetriever(FakeQdrant, "c", lambda q: [1.0]).retrieve(asked).collect()
    made = types.SimpleNamespace(
        Filter=lambda must: must[0], FieldCondition=lambda key, match: (key, match), MatchValue=lambda value: value
    )
    monkeypatch.setitem(sys.modules, "qdrant_client", types.SimpleNamespace(models=made))
    from tidemark.sources.retrievers import qdrant_filter

    assert qdrant_filter("namespace", "x") == ("namespace", "x")


SOURCES = {
    "qdrant": (lambda: datasources.qdrant(FakeQdrant, "c", make_filter=pair, page=2), 1, 1),
    "qdrant_by_namespace": (lambda: datasources.qdrant(FakeQdrant, "c", namespaces=["x", "y"], make_filter=pair, page=1), 2, 1),
    "chroma": (lambda: datasources.chroma(FakeChroma, page=2), 3, 1),
    "pgvector": (lambda: datasources.pgvector(FakePg, "t", parts=3, page=1), 3, 3),
}


@pytest.mark.parametrize("kind", SOURCES)
def test_collections_as_data_sources(spark, kind):
    make, parts, parts_of_one = SOURCES[kind]
    every = {x for x in EVERY if kind != "qdrant_by_namespace" or x[3]}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        datasources.register(spark, f"test_{kind}", make())
        table = spark.read.format(f"test_{kind}").load()
        rows = lambda df: {(*r[:4], r[4] and tuple(r[4])) for r in df.collect()}
        assert rows(table) == every and table.count() == len(every) and table.rdd.getNumPartitions() == parts
        one = table.where("namespace = 'x'")
        assert rows(one) == {x for x in every if x[3] == "x"} and one.rdd.getNumPartitions() == parts_of_one
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan.replace("isnotnull(namespace", "") or "= x)" not in plan  # the database does it
        assert rows(table.where("namespace IN ('x', 'y') AND text <> ''")) == {x for x in every if x[3] and x[1]}
        assert rows(table.where("namespace = 'x' AND namespace IN ('y')")) == set() == rows(table.where("namespace = 'nobody'"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
