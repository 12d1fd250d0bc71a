"""The unit store: a committed Parquet log of units, its latest view, and units as JSON."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

#: Folders whose numbers are broadcast at most (some 60 bytes each).
BROADCAST_FOLDERS = 100_000
CHUNK = "struct<artifact_id:string,text:string,version:string,content_hash:string>"
SPAN = "struct<artifact_id:string,version:string,span:string,content_hash:string>"
UNIT_SCHEMA = (
    "id string, namespace string, query string, query_embedding array<double>, understanding string, "
    f"evidence array<{CHUNK}>, provenance struct<model_version:string,prompt_version:string,"
    f"source_spans:array<{SPAN}>,observed_edges:array<string>>, understanding_embedding array<double>, "
    "claim_embeddings array<array<double>>, hit_queries array<string>, status string, freshness_epoch double, "
    "hits bigint, created_at double, last_access double"
)
LOG_SCHEMA = f"store_prefix string, batch_id bigint, seq bigint, op string, {UNIT_SCHEMA}"


def to_json(units: DataFrame) -> DataFrame:
    """(id, body): each unit as one JSON text."""
    return units.select("id", F.to_json(F.struct(*[f.split()[0] for f in _fields()])).alias("body"))


def _fields() -> list[str]:
    return [f.strip() for f in (
        "id string", "namespace string", "query string", "query_embedding x", "understanding string", "evidence x", "provenance x",
        "understanding_embedding x", "claim_embeddings x", "hit_queries x", "status string", "freshness_epoch double", "hits bigint",
        "created_at double", "last_access double")]


def decoded(body: Column) -> Column:
    """A unit from its JSON text, missing parts as their defaults; null where the text is no unit."""
    return F.get(_units(body), F.lit(0))


def _units(body: Column) -> Column:
    """The unit of a JSON text as an array of one, or of none. The text is parsed once: what follows is bound to its value."""
    parsed = F.array(F.from_json(body, UNIT_SCHEMA, {"mode": "PERMISSIVE"}))
    return F.transform(F.filter(parsed, lambda u: u["id"].isNotNull() & u["provenance"].isNotNull()), _whole)


def _whole(u: Column) -> Column:
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(
        u["id"].alias("id"), F.coalesce(u["namespace"], F.lit("")).alias("namespace"), F.coalesce(u["query"], F.lit("")).alias("query"),
        F.coalesce(u["query_embedding"], empty("double")).alias("query_embedding"), F.coalesce(u["understanding"], F.lit("{}")).alias("understanding"),
        F.coalesce(u["evidence"], empty(CHUNK)).alias("evidence"), u["provenance"].alias("provenance"),
        F.coalesce(u["understanding_embedding"], empty("double")).alias("understanding_embedding"),
        F.coalesce(u["claim_embeddings"], empty("array<double>")).alias("claim_embeddings"), F.coalesce(u["hit_queries"], empty("string")).alias("hit_queries"),
        F.coalesce(u["status"], F.lit("fresh")).alias("status"), F.coalesce(u["freshness_epoch"], F.lit(0.0)).alias("freshness_epoch"),
        F.coalesce(u["hits"], F.lit(0)).cast("bigint").alias("hits"), F.coalesce(u["created_at"], F.lit(0.0)).alias("created_at"),
        F.coalesce(u["last_access"], F.lit(0.0)).alias("last_access"),
    )


def from_json(rows: DataFrame, body: str = "body") -> DataFrame:
    """Units of all rows that decode; the others are left out."""
    return rows.select(F.inline(_units(F.col(body))))


def latest(log: DataFrame, key: str = "id") -> DataFrame:
    """The last entry of each key in (batch_id, seq) order unless it is a delete, with the key's first seq.

    Places of a key differ. Only keys and places are aggregated, in each task first; the entries that hold
    the last places are then joined, so where these are few the log itself isn't shuffled.
    """
    by = [c for c in ("store_prefix",) if c in log.columns] + [key]
    places = log.groupBy(*by).agg(F.max(F.struct("batch_id", "seq", "op")).alias("_last"), F.min(F.struct("batch_id", "seq")).alias("_first"))
    last = places.where("_last.op <> 'delete'").select(*by, F.col("_last.batch_id").alias("batch_id"), F.col("_last.seq").alias("seq"), F.col("_first.seq").alias("first_seq"))
    return log.where("op <> 'delete'").join(last, [*by, "batch_id", "seq"])


class Store(ABC):
    """What a cache asks of a store. Units have one id each; the last put of an id counts."""

    @abstractmethod
    def write(self, units: DataFrame | None, gone: DataFrame | Iterable[str] | None = None, batch_id: int | None = None) -> bool:
        """Put units and delete ids as one batch; False if the store has a batch of that id."""

    @abstractmethod
    def all(self) -> DataFrame:
        """The units, with a column place that gives their order."""

    def put(self, units: DataFrame, batch_id: int | None = None) -> bool:
        return self.write(units, None, batch_id)

    def delete(self, ids: DataFrame | Iterable[str], batch_id: int | None = None) -> bool:
        return self.write(None, ids, batch_id)

    def get(self, unit_id: str) -> DataFrame:
        return self.all().where(F.col("id") == unit_id)

    def __len__(self) -> int:
        return self.all().count()


def entries(spark: SparkSession, units: DataFrame | None, gone: DataFrame | Iterable[str] | None) -> DataFrame:
    """(seq, op, unit) rows of one batch: puts by their seq if they have one, deletes after them."""
    empty = spark.createDataFrame([], f"seq bigint, op string, {UNIT_SCHEMA}")
    kinds = {f.name: f.dataType for f in empty.schema}
    parts = [empty]
    if gone is not None and not isinstance(gone, DataFrame):
        gone = spark.createDataFrame([(i,) for i in gone], "id string")
    for rows, op in ((units, "put"), (None if gone is None else gone.select("id"), "delete")):
        if rows is not None:
            seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id() if op == "put" else F.lit((1 << 63) - 1)
            cols = [(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in kinds if n not in ("seq", "op")]
            parts.append(rows.select(seq.cast("bigint").alias("seq"), F.lit(op).alias("op"), *cols))
    return reduce(DataFrame.unionByName, parts)


class EphemeralStore(Store):
    """A store that lives as long as its object: batches are kept as they are given, as plans, and nothing is written.

    A batch whose rows aren't in a table should be one (``written``) before it is put.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.batches, self.applied = spark, [], set()

    def write(self, units: DataFrame | None, gone: DataFrame | Iterable[str] | None = None, batch_id: int | None = None) -> bool:
        if batch_id is not None and batch_id in self.applied:
            return False
        self.applied.add(batch_id)
        self.batches.append(entries(self.spark, units, gone).withColumn("batch_id", F.lit(len(self.batches) + 1).cast("bigint")))
        return True

    def all(self) -> DataFrame:
        log = reduce(DataFrame.unionByName, self.batches) if self.batches else entries(self.spark, None, None).withColumn("batch_id", F.lit(1).cast("bigint"))
        return _shown(latest(log))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(*[f.split()[0] for f in _fields()], F.struct("batch_id", "first_seq").alias("place"))


class UnitStore(Store):
    """Units in a folder: a batch of puts and deletes is a folder of Parquet files and one commit; reads see the latest view.

    Batches are ordered by their commits. A batch id that the prefix has is not applied again, so a retried
    batch does no harm, and what a writer left without commit is never seen. A prefix is a partition of the
    data, compared as it is; all prefixes share the commits. Log entries of compacted units keep the places
    they had; tombstones go with compaction, so an id that is put again after it is a new one.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: str = "units"):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        self.commits = CommitLog(spark, f"{self.path}/commits")

    def _folder(self, token: str) -> str:
        return f"{self.path}/data/token={token}"

    def _entries(self, live: dict[str, int]) -> DataFrame:
        """The log entries of all prefixes in some folders, batch_id being the number of the commit or the place kept."""
        names = [f.split()[0] for f in LOG_SCHEMA.split(", ")[:4]] + [f.split()[0] for f in _fields()]
        if not live:
            return self.spark.createDataFrame([], LOG_SCHEMA).select(*names)
        schema = f"{LOG_SCHEMA}, token string"
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*map(self._folder, live))
        numbers = self.spark.createDataFrame(list(live.items()), "token string, version bigint")
        if len(live) <= BROADCAST_FOLDERS:
            numbers = F.broadcast(numbers)
        rows = rows.join(numbers, "token").withColumn("batch_id", F.coalesce("batch_id", "version"))
        return rows.select(*names)

    def log(self) -> DataFrame:
        """The entries as of now; what is committed later, compaction too, doesn't change it."""
        return self._entries(self.commits.state().live).where(F.col("store_prefix") == self.prefix)

    def _commit(self, rows: DataFrame, entry: dict) -> bool:
        """Write ``rows`` to a folder of its own and commit it; without a commit the folder goes again."""
        token = uuid.uuid4().hex
        rows.write.partitionBy("store_prefix").parquet(self._folder(token))
        done = self.commits.commit(entry | {"add": [token]}) is not None
        if not done:
            self._remove(token)
        return done

    def _remove(self, token: str) -> None:
        self.commits.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(token)), True)

    def write(self, units: DataFrame | None, gone: DataFrame | Iterable[str] | None = None, batch_id: int | None = None) -> bool:
        if self.commits.state().has(self.prefix, batch_id):
            return False
        rows = entries(self.spark, units, gone).withColumns({"store_prefix": F.lit(self.prefix), "batch_id": F.lit(None).cast("bigint")})
        return self._commit(rows, {"prefix": self.prefix, "batch": batch_id, "gone": []})

    def all(self) -> DataFrame:
        return _shown(latest(self.log()))

    def compact(self) -> bool:
        """Replace what is live now, of all prefixes, by its latest view; False if another compaction came first.

        Batches committed meanwhile stay live beside it. Old folders stay for readers that have them until ``vacuum``.
        """
        live = self.commits.state().live
        if not live:
            return False
        now = latest(self._entries(live)).drop("seq").withColumnRenamed("first_seq", "seq")
        return self._commit(now, {"prefix": self.prefix, "batch": None, "gone": sorted(live)})

    def vacuum(self, older_than_s: float = 7 * 86400) -> int:
        """Remove folders that are not live and older than any reader or writer may be; how many went."""
        fs, live = self.commits.fs, self.commits.state().live
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        found = fs.listStatus(data) if fs.exists(data) else []
        dead = [f for f in found if f.getPath().getName().removeprefix("token=") not in live and time.time() - f.getModificationTime() / 1000 >= older_than_s]
        for f in dead:
            fs.delete(f.getPath(), True)
        return len(dead)
