"""Event connectors: webhook payloads (JSON text) to change events, as columns.

A connector is a function from the payload column to an array of events (artifact_id, version, span,
content_hash, kind); ``dispatch`` explodes and numbers them.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVENT = "array<struct<artifact_id:string,version:string,span:string,content_hash:string,kind:string>>"


class UnknownSource(ValueError):
    """A payload names a source that no connector is registered for."""


def _event(artifact: Column, version: Column, kind: Column | str, span: Column | None = None, digest: Column | None = None) -> Column:
    return F.struct(
        artifact.alias("artifact_id"), F.coalesce(version, F.lit("")).alias("version"),
        (F.lit(None).cast("string") if span is None else span).alias("span"),
        (F.lit("") if digest is None else F.coalesce(digest, F.lit(""))).alias("content_hash"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
    )


def _none() -> Column:
    return F.array().cast(_EVENT)


def github(payload: Column) -> Column:
    """A push or pull request: one event for each path, distinct, in order; removed paths are updates too."""
    p = F.from_json(
        payload,
        "struct<after:string,commits:array<struct<added:array<string>,modified:array<string>,removed:array<string>>>,"
        "pull_request:struct<merge_commit_sha:string,files:array<string>>>",
    )
    empty = F.array().cast("array<string>")
    commits = F.coalesce(p["commits"], F.array().cast("array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"))
    each = lambda name: F.flatten(F.transform(commits, lambda c: F.coalesce(c[name], empty)))
    files = F.transform(
        F.coalesce(p["pull_request"]["files"], empty),
        lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.filename"), F.lit(""))).otherwise(x),
    )
    paths = F.array_sort(F.array_distinct(F.filter(F.concat(each("added"), each("modified"), each("removed"), files), lambda x: x != "")))
    blank = lambda x: F.when(x == "", None).otherwise(x)
    version = F.coalesce(blank(p["after"]), blank(p["pull_request"]["merge_commit_sha"]), F.lit(""))
    return F.transform(paths, lambda x: _event(F.concat(F.lit("github:"), x), version, "github.push"))


def deploy(payload: Column) -> Column:
    p = F.from_json(payload, "struct<service:string,version:string>")
    has = F.coalesce(p["service"], F.lit("")) != ""
    return F.when(has, F.array(_event(F.concat(F.lit("deploy:"), p["service"]), p["version"], "deploy"))).otherwise(_none())


def jira(payload: Column) -> Column:
    p = F.from_json(payload, "struct<issue:struct<key:string,fields:struct<updated:string>>>")
    key, updated = p["issue"]["key"], p["issue"]["fields"]["updated"]
    has = F.coalesce(key, F.lit("")) != ""
    return F.when(has, F.array(_event(F.concat(F.lit("jira:"), key), updated, "jira.update"))).otherwise(_none())


def cdc(payload: Column) -> Column:
    """Change data capture: the items of ``changes``, or the payload as the only one; those without id are left out."""
    item = "struct<artifact_id:string,version:string,span:string,content_hash:string,kind:string>"
    many = F.from_json(payload, "struct<changes:array<string>>")["changes"]
    items = F.transform(F.coalesce(many, F.array(payload)), lambda x: F.from_json(x, item))
    kept = F.filter(items, lambda x: F.coalesce(x["artifact_id"], F.lit("")) != "")
    return F.transform(
        kept, lambda x: _event(x["artifact_id"], x["version"], F.coalesce(x["kind"], F.lit("cdc")), x["span"], x["content_hash"])
    )


def default_connectors() -> dict[str, Callable[[Column], Column]]:
    return {"github": github, "deploy": deploy, "jira": jira, "cdc": cdc}


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def verify_signature(secret: str, body: bytes, given: str | None) -> bool:
    return bool(given) and hmac.compare_digest(signature(secret, body), given)


def signed(body: Column, given: Column, secret: str) -> Column:
    """Whether each body carries a valid signature; HMAC is no Spark function, so Arrow batches go to Python."""

    @F.pandas_udf("boolean")
    def check(bodies: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([verify_signature(secret, (b or "").encode(), m) for b, m in zip(bodies, marks)])

    return check(body, given)


class Dispatcher:
    """Routes payloads to connectors by source, and their events, in order, to a sink."""

    def __init__(self, sink: Callable[[DataFrame], object] | None = None, connectors: dict[str, Callable[[Column], Column]] | None = None):
        self.sink = sink
        self.connectors = dict(default_connectors() if connectors is None else connectors)

    def register(self, source: str, connector: Callable[[Column], Column]) -> None:
        """A later connector for a source takes the place of an earlier one."""
        self.connectors[source] = connector

    def dispatch(self, payloads: DataFrame, secret: str | None = None) -> DataFrame:
        """(seq, pos, artifact_id, version, span, content_hash, kind) of ``payloads`` (seq, source, payload[, signature]).

        With a secret, github payloads without valid signature raise PermissionError; unknown sources raise.
        """
        unknown = payloads.where(~F.col("source").isin(list(self.connectors))).select("source").limit(1).collect()
        if unknown:
            raise UnknownSource(unknown[0]["source"])
        if secret is not None and "github" in self.connectors:
            bad = payloads.where("source = 'github'").where(~signed(F.col("payload"), F.col("signature"), secret))
            if bad.limit(1).collect():
                raise PermissionError("a payload's signature does not verify")
        events = events_of(payloads, self.connectors)
        if self.sink:
            self.sink(events)
        return events


def events_of(payloads: DataFrame, connectors: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The events of all payloads of known sources; lazy, for streams as well."""
    found = _none()
    for source, connector in (connectors or default_connectors()).items():
        found = F.when(F.col("source") == source, connector(F.col("payload"))).otherwise(found)
    rows = payloads.select("seq", F.posexplode(found).alias("pos", "event"))
    return rows.select("seq", "pos", "event.*")


def numbered(events: DataFrame) -> DataFrame:
    """Events with event_seq, their order over payloads and positions (in batches, where a total order exists)."""
    key = F.shiftleft(F.col("seq"), 20) + F.col("pos")
    return events.withColumn("event_seq", key)


