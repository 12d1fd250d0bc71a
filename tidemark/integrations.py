"""The cache for graph nodes, tool servers and web applications."""

from __future__ import annotations

import asyncio
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from .plans.cache import ContextCache
from .sources.connectors import Dispatcher, UnknownSource, verify_signature


def graph_node(cache: ContextCache, *, query_key: str = "question", output_key: str = "context", namespace: str | None = None) -> Callable[[dict], dict]:
    """A node that reads its query from the state (empty where it has none) and returns the context under a key."""

    def node(state: dict[str, Any]) -> dict[str, Any]:
        return {output_key: cache.get(state.get(query_key) or "", namespace=namespace).context}

    return node


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    handler: Callable[..., dict[str, Any]]
    input_schema: dict[str, Any] = field(default_factory=dict)


def tools(cache: ContextCache) -> list[Tool]:
    """The one tool of a tool server: get_context(query, namespace?)."""

    def get_context(query: str, namespace: str | None = None) -> dict[str, Any]:
        r = cache.get(query, namespace=namespace)
        sources = [c.artifact_id for c in r.evidence]
        return {"context": r.context, "raw": r.raw_text, "sources": sources, "cache_hit": r.cache_hit, "coverage": r.coverage}

    schema = {"type": "object", "properties": {"query": {"type": "string"}, "namespace": {"type": "string"}}, "required": ["query"]}
    return [Tool("get_context", "Fresh context for a question, with its sources.", get_context, schema)]


def _payload(body: bytes) -> str:
    """The text of a JSON payload; anything else raises ValueError."""
    text = body.decode()
    json.loads(text)
    return text


def receive_webhook(dispatcher: Dispatcher, source: str, body: bytes, signature: str | None = None, secret: str | None = None) -> tuple[int, dict[str, Any]]:
    """(HTTP status, reply) for one payload: 400 if it is no JSON, 404 for unknown sources, 401 for bad signatures."""
    try:
        text = _payload(body)
    except ValueError as e:
        return 400, {"detail": f"malformed payload: {e}"}
    payloads = SparkSession.active().createDataFrame([(0, source, text, signature)], "seq bigint, source string, payload string, signature string")
    try:
        return 200, {"accepted": dispatcher.dispatch(payloads, secret).count()}
    except UnknownSource as e:
        return 404, {"detail": str(e)}
    except PermissionError as e:
        return 401, {"detail": str(e)}


class Landing:
    """Webhooks as files in a folder that ``streaming.changes.stream_landed`` reads: a payload costs a file, not a Spark job.

    The folder is one that the receivers and Spark's executors share, as a path of the operating system. A file
    is there whole or not at all, and receivers need neither Spark nor each other.
    """

    def __init__(self, folder: str, sources: Iterable[str] = ("github", "deploy", "jira", "cdc"), secret: str | None = None):
        self.folder, self.sources, self.secret = folder, set(sources), secret
        os.makedirs(folder, exist_ok=True)

    def __call__(self, source: str, body: bytes, signature: str | None = None) -> tuple[int, dict[str, Any]]:
        """The replies of ``receive_webhook``, but for 202 with the name under which a payload landed."""
        try:
            text = _payload(body)
        except ValueError as e:
            return 400, {"detail": f"malformed payload: {e}"}
        if source not in self.sources:
            return 404, {"detail": f"unknown source: {source}"}
        if self.secret is not None and source == "github" and not verify_signature(self.secret, body, signature):
            return 401, {"detail": "a payload's signature does not verify"}
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        draft = os.path.join(self.folder, f".{name}")  # file sources leave hidden files out
        with open(draft, "w", encoding="utf-8") as f:
            f.write(json.dumps({"name": name, "source": source, "payload": text}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(draft, os.path.join(self.folder, f"{name}.json"))
        return 202, {"landed": name}


def web_application(handle: Callable[[str, bytes, str | None], tuple[int, dict[str, Any]]], *, largest: int = 10_000_000) -> Callable:
    """An ASGI application that gives the payloads of POST /webhooks/{source} to ``handle``, in a thread of its own.

    ``handle`` is a ``Landing``, or ``partial(receive_webhook, dispatcher)`` where each payload may be a Spark job.
    Any ASGI server runs it, and a web framework mounts it as it is.
    """

    async def body_of(receive: Callable) -> bytes | None:
        parts, size, more = [], 0, True
        while more:
            message = await receive()
            part, more = message.get("body", b""), message.get("more_body", False)
            size += len(part)
            if size <= largest:
                parts.append(part)
        return b"".join(parts) if size <= largest else None

    async def application(scope: dict, receive: Callable, send: Callable) -> None:
        if scope["type"] == "lifespan":
            while (message := await receive())["type"] == "lifespan.startup":
                await send({"type": "lifespan.startup.complete"})
            await send({"type": "lifespan.shutdown.complete"})
            return
        if scope["type"] != "http":
            return
        path = scope["path"].removeprefix(scope.get("root_path", ""))
        found = re.fullmatch(r"/webhooks/([^/]+)", path)
        if not found:
            status, reply = 404, {"detail": "not found"}
        elif scope["method"] != "POST":
            status, reply = 405, {"detail": "method not allowed"}
        elif (body := await body_of(receive)) is None:
            status, reply = 413, {"detail": f"over {largest} bytes"}
        else:
            marks = [v.decode("latin-1") for k, v in scope["headers"] if k.lower() == b"x-hub-signature-256"]
            status, reply = await asyncio.to_thread(handle, found[1], body, marks[0] if marks else None)
        content = json.dumps(reply).encode()
        await send({"type": "http.response.start", "status": status, "headers": [(b"content-type", b"application/json"), (b"content-length", str(len(content)).encode())]})
        await send({"type": "http.response.body", "body": content})

    return application
