"""Vector databases as Spark data sources: ``spark.read.format(name)`` over whole collections, in partitions.

``register`` makes a source of a ``Collection``: how to open it, its partitions, and how a worker reads one of
them. Rows are artifact_id, text, version, namespace, embedding. Equality and membership of the namespace are
pushed to the database (``spark.sql.python.filterPushdown.enabled``), together with empty ids being left out;
other filters stay with Spark. Clients are opened in workers, so nothing of them is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..base import ship
from .retrievers import _plain_name, qdrant_filter

ROWS = "artifact_id string, text string, version string, namespace string, embedding array<double>"
#: The partition of a source that has none.
NOTHING = "nothing"
#: Rows of one request to a database.
PAGE = 1000


@dataclass(frozen=True)
class Collection:
    """What a source reads: partitions for a set of namespaces (None: all), and the rows of one partition."""

    partitions: Callable[[Sequence[str] | None], list[Any]]
    rows: Callable[[Any], Iterator[tuple]]


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _vector(value: Any) -> list[float] | None:
    return None if value is None else [float(x) for x in value]


def qdrant(
    client: Callable[[], Any], collection: str, namespaces: Sequence[str] | None = None, id_field: str = "artifact_id", text_field: str = "text",
    version_field: str = "version", namespace_field: str = "namespace", make_filter: Callable[[str, str], Any] = qdrant_filter, page: int = PAGE,
) -> Collection:
    """A Qdrant collection, scrolled page by page; one partition for each of ``namespaces``, or for those asked for, else one."""

    def partitions(wanted: Sequence[str] | None) -> list[Any]:
        if namespaces is None:
            return [None] if wanted is None else list(wanted)
        return [n for n in namespaces if wanted is None or n in wanted]

    def rows(namespace: str | None) -> Iterator[tuple]:
        opened, at = client(), None
        while True:
            where = None if namespace is None else make_filter(namespace_field, namespace)
            points, at = opened.scroll(collection_name=collection, scroll_filter=where, limit=page, offset=at, with_payload=True, with_vectors=True)
            for point in points:
                own = point.payload or {}
                yield _text(own.get(id_field)), _text(own.get(text_field)), _text(own.get(version_field)), own.get(namespace_field), _vector(point.vector)
            if at is None:
                return

    return Collection(partitions, rows)


def chroma(
    collection: Callable[[], Any], id_field: str = "artifact_id", version_field: str = "version", namespace_field: str = "namespace", page: int = PAGE
) -> Collection:
    """A Chroma collection; a partition is a page, or a namespace asked for, which is read page by page."""

    def partitions(wanted: Sequence[str] | None) -> list[Any]:
        return [(None, at) for at in range(0, collection().count(), page)] if wanted is None else [(n, None) for n in wanted]

    def rows(part: tuple[str | None, int | None]) -> Iterator[tuple]:
        namespace, at = part
        opened, where = collection(), {} if namespace is None else {"where": {namespace_field: namespace}}
        first = at or 0
        while True:
            got = opened.get(limit=page, offset=first, include=["documents", "metadatas", "embeddings"], **where)
            for i, own_id in enumerate(got["ids"]):
                meta = got["metadatas"][i] or {}
                yield _text(meta.get(id_field) or own_id), _text(got["documents"][i]), _text(meta.get(version_field)), meta.get(namespace_field), _vector(got["embeddings"][i])
            first += page
            if at is not None or len(got["ids"]) < page:
                return

    return Collection(partitions, rows)


def pgvector(
    connection: Callable[[], Any], table: str, parts: int = 8, id_column: str = "artifact_id", text_column: str = "text", version_column: str = "version",
    embedding_column: str = "embedding", namespace_column: str = "namespace", page: int = PAGE,
) -> Collection:
    """A PostgreSQL table with vectors, ``parts`` partitions by the hash of its ids."""
    names = [id_column, text_column, version_column, namespace_column]
    for name in (table, *names, embedding_column):
        _plain_name(name)

    def partitions(wanted: Sequence[str] | None) -> list[Any]:
        return [(i, None if wanted is None else list(wanted)) for i in range(parts)]

    def rows(part: tuple[int, list[str] | None]) -> Iterator[tuple]:
        number, wanted = part
        only = "" if wanted is None else f" AND {namespace_column} = ANY(%s)"
        sql = f"SELECT {', '.join(names)}, {embedding_column}::real[] FROM {table} WHERE mod(abs(hashtext({id_column}::text)::bigint), %s) = %s{only}"
        with connection().cursor() as cursor:
            cursor.execute(sql, (parts, number, *([] if wanted is None else [wanted])))
            while found := cursor.fetchmany(page):
                for own_id, text, version, namespace, vector in found:
                    yield _text(own_id), _text(text), _text(version), namespace, _vector(vector)

    return Collection(partitions, rows)


def register(spark: SparkSession, name: str, collection: Collection) -> None:
    """Make ``collection`` readable as ``spark.read.format(name)``.

    The source is planned in a Python process of the driver's that doesn't have this package, which it
    therefore carries as bytes, to be opened where it was shipped to.
    """
    import sys
    from pathlib import Path

    ship(spark)
    rows, nothing = ROWS, NOTHING
    carried, root = CloudPickleSerializer().dumps(collection), str(Path(__file__).resolve().parents[2])

    def opened() -> Any:
        import pickle

        if root not in sys.path:
            sys.path.append(root)
        return pickle.loads(carried)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return rows

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def __init__(self) -> None:
            self.wanted: list[str] | None = None

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
            for f in filters:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
                if values is None or f.attribute != ("namespace",):
                    yield f
                else:
                    values = [v for v in dict.fromkeys(values) if v is not None]
                    self.wanted = values if self.wanted is None else [v for v in self.wanted if v in values]

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in opened().partitions(self.wanted)] or [InputPartition(nothing)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value == nothing:
                return
            for row in opened().rows(partition.value):
                if row[0]:
                    yield row

    spark.dataSource.register(Source)
