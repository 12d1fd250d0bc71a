"""Webhooks over HTTP: the application's replies, payloads that land as files without a job, and streams that apply them once."""

import asyncio
import json
import os
from functools import partial

from tidemark.integrations import Landing, receive_webhook, web_application
from tidemark.plans.engine import text_hash
from tidemark.sources.connectors import Dispatcher, signature
from tidemark.sources.store import UnitStore
from tidemark.streaming.changes import stream_landed


def post(app, path, body=b"", method="POST", headers=(), parts=1, root=""):
    """One request to an ASGI application: (status, reply)."""
    cut = -(-len(body) // parts) or 1
    pieces = [body[i : i + cut] for i in range(0, len(body), cut)] or [b""]
    messages = [{"type": "http.request", "body": x, "more_body": i + 1 < len(pieces)} for i, x in enumerate(pieces)]
    sent = []

    async def receive():
        return messages.pop(0)

    async def send(message):
        sent.append(message)

    asyncio.run(app({"type": "http", "method": method, "path": root + path, "root_path": root, "headers": list(headers)}, receive, send))
    assert dict(sent[0]["headers"])[b"content-length"] == str(len(sent[1]["body"])).encode()
    return sent[0]["status"], json.loads(sent[1]["body"])


def cdc(*ids, kind="update"):
    return json.dumps({"changes": [{"artifact_id": i, "content_hash": text_hash("new"), "kind": kind} for i in ids]}).encode()


def test_replies(tmp_path):
    app = web_application(Landing(f"{tmp_path}/in", secret="k"), largest=1000)
    assert post(app, "/webhooks/cdc", cdc("a"), parts=3)[0] == 202 and post(app, "/webhooks/cdc", cdc("b"), root="/hooks")[0] == 202
    mark = (b"X-Hub-Signature-256", signature("k", b"{}").encode())
    assert post(app, "/webhooks/github", b"{}", headers=[mark])[0] == 202
    before = len(os.listdir(f"{tmp_path}/in"))
    assert post(app, "/webhooks/github", b"{}")[0] == 401 and post(app, "/webhooks/github", b"{ }", headers=[mark])[0] == 401
    assert post(app, "/webhooks/gitlab", b"{}")[0] == 404 and post(app, "/other", b"{}")[0] == 404 and post(app, "/webhooks/cdc/x", b"{}")[0] == 404
    assert post(app, "/webhooks/cdc", method="GET")[0] == 405 and post(app, "/webhooks/cdc", b"x" * 1001, parts=4)[0] == 413
    assert post(app, "/webhooks/cdc", b"{")[0] == post(app, "/webhooks/cdc", b"\xff")[0] == post(app, "/webhooks/cdc")[0] == 400
    assert len(os.listdir(f"{tmp_path}/in")) == before == 3


def test_lifespan(tmp_path):
    messages, sent = [{"type": "lifespan.startup"}, {"type": "lifespan.shutdown"}], []

    async def receive():
        return messages.pop(0)

    async def send(message):
        sent.append(message["type"])

    asyncio.run(web_application(Landing(f"{tmp_path}/in"))({"type": "lifespan"}, receive, send))
    assert sent == ["lifespan.startup.complete", "lifespan.shutdown.complete"]


def test_a_dispatcher_behind_the_application(spark):
    seen = []
    dispatcher = Dispatcher(lambda events: seen.extend(r["artifact_id"] for r in events.collect()))
    app = web_application(partial(receive_webhook, dispatcher))
    assert post(app, "/webhooks/cdc", cdc("a", "b")) == (200, {"accepted": 2}) and seen == ["a", "b"]


def test_landed_payloads_reach_the_store_once(spark, tmp_path):
    span = lambda a: [{"artifact_id": a, "version": "v1", "span": None, "content_hash": text_hash(a)}]
    made = {"model_version": "m", "prompt_version": "p", "observed_edges": []}
    rows = [(f"u{a}", "", a, made | {"source_spans": span(a)}, "fresh") for a in "abcd"]
    p = "struct<model_version:string,prompt_version:string,source_spans:array<struct<artifact_id:string,version:string,span:string,content_hash:string>>,observed_edges:array<string>>"
    store = UnitStore(spark, f"file://{tmp_path}/units")
    store.put(spark.createDataFrame(rows, f"id string, namespace string, query string, provenance {p}, status string"))
    app = web_application(Landing(f"{tmp_path}/in"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    applied = []

    def run():
        done = lambda actions, batch: applied.extend((batch, r["unit"], r["action"]) for r in actions.collect())
        stream_landed(spark, f"{tmp_path}/in", store, f"{tmp_path}/check", files=2, done=done).awaitTermination()

    before = jobs()
    for body in (cdc("a"), cdc("b", "nobody"), cdc("b", kind="delete"), cdc("b")):
        assert post(app, "/webhooks/cdc", body)[0] == 202
    assert jobs() == before  # a POST is no job
    run()
    assert {r["id"]: r["status"] for r in store.all().collect()} == {"ua": "dirty", "uc": "fresh", "ud": "fresh"}
    assert post(app, "/webhooks/cdc", cdc("c"))[0] == 202
    run()
    run()  # nothing new
    assert {r["id"]: r["status"] for r in UnitStore(spark, f"file://{tmp_path}/units").all().collect()} == {"ua": "dirty", "uc": "dirty", "ud": "fresh"}
    assert sorted(x[1:] for x in applied) == [("ua", "dirty"), ("ub", "dirty"), ("ub", "evict"), ("uc", "dirty")]
