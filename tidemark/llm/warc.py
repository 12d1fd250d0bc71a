"""WARC archives of pages, and their index by external merging.

Writing. Workers write gzip members, a record each, into WARC/1.1 files of about ``FILE_BYTES``. Of captures
with equal payloads of at least ``LEAST_PAYLOAD`` bytes the one with the smallest id is a response and the
others are revisits of it, with headers but no payload; the digests that repeat are found by aggregation, so
no group of copies, however large, meets in one task.

Index. Each task also sorts its index entries by (URL key, timestamp, id) and writes them as a run: an Arrow
file whose blocks stay within one key range. Ranges come from a sample of the keys, ``SAMPLE`` a range.
For each range one task merges that part of all runs with a loser tree, reading a block of each run at a
time; more runs than ``FAN_IN`` are merged in several passes, in which each group of runs and range is a task
that writes as it merges. The ranges in order are the capture history of all URLs in global order, written
as index files.

Reading goes through the merged index: the archives' records are read at the places it names, digests are
checked, and a revisit's payload length and digest are those its headers give.

Edge cases: null html is an empty payload, a null URL the empty one; null ids come first; rows equal in id
and payload are one capture given twice, both alike; an empty table gives no files and no rows; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, ship

LEAST_PAYLOAD = 100
FILE_BYTES, ROLL_RECORDS = 64_000_000, 20_000
PER_RANGE, SAMPLE = 200_000, 16
FAN_IN, BLOCK_ROWS = 64, 2048
#: Date of a capture without one: this instant and its id in seconds.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
ENTRY = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()),
    ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()),
])
ENTRY_SQL = (
    "url_key string, timestamp string, page_id bigint, url string, record_type string, refers_to bigint, "
    "digest string, length bigint, file string, offset bigint, size bigint"
)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host parts from the last, then path and query, in lower case; no scheme, www or fragment."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, port = (host.rsplit("@", 1)[-1].split(":", 1) + [""])[:2]
    host = host.removeprefix("www.")
    port = "" if port in ("", "80", "443") else ":" + port
    path, _, query = path.partition("?")
    query = "&".join(sorted(query.split("&"))) if query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (slash and "/" + path) + ("?" + query if query else "")


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so a step replays one path."""

    _END = object()

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.n = runs, key, max(1, len(runs))
        self.heads = [next(r, self._END) for r in runs] or [self._END]
        self.tree = [-1] * self.n
        for i in range(self.n):
            self._replay(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is self._END or b is self._END:
            return b is self._END and a is not self._END
        ka, kb = self.key(a), self.key(b)
        return ka < kb or (ka == kb and i < j)

    def _replay(self, winner: int) -> None:
        at = (winner + self.n) // 2
        while at > 0:
            if self.tree[at] < 0:  # while the tree is built: wait for the other side
                self.tree[at] = winner
                return
            if self._before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[self.tree[0]] is not self._END:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], self._END)
            self._replay(winner)


def _order(e: dict) -> tuple:
    return (e["url_key"], e["timestamp"], e["page_id"] is not None, e["page_id"] or 0, e["digest"])


def _write(uri: str, raw: bytes) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as f:
        f.write(raw)
    system.move(own, path)


def _record(row: dict, digest: str, payload: bytes, date: str) -> bytes:
    revisit = row["refers_to"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\r\n]+", "%0A", row["url"] or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": "" if row["page_id"] is None else str(row["page_id"]),
    }
    if revisit:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": name(row["refers_to"]),
            "WARC-Refers-To-Page-ID": str(row["refers_to"]),
        }
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    return fields, block


def _run_file(entries: list[dict], splits: list[tuple]) -> bytes:
    """A sorted run as an Arrow file; each block is within one range, which its custom data names."""
    entries.sort(key=_order)
    out, blocks, at = io.BytesIO(), [], 0
    writer = pa.ipc.new_file(out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd"))
    for r in range(len(splits) + 1):
        end = at
        while end < len(entries) and (r == len(splits) or _order(entries[end])[:4] < splits[r]):
            end += 1
        for first in range(at, end, BLOCK_ROWS):
            writer.write_batch(pa.RecordBatch.from_pylist(entries[first : min(end, first + BLOCK_ROWS)], ENTRY))
            blocks.append(r)
        at = end
    writer.close()
    head = json.dumps(blocks).encode()
    return len(head).to_bytes(8, "little") + head + out.getvalue()


def _run_part(uri: str, wanted: int) -> Iterator[dict]:
    """The entries of one range of a run, a block in memory at a time. A merged run is a folder, a file a range."""
    merged = uri.endswith("/")
    system, path = fs.FileSystem.from_uri(f"{uri}{wanted}.run" if merged else uri)
    with system.open_input_file(path) as f:
        if merged:
            reader = pa.ipc.open_file(f)
            blocks = [wanted] * reader.num_record_batches
        else:
            size = int.from_bytes(f.read(8), "little")
            blocks = json.loads(f.read(size))
            if wanted not in blocks:
                return
            reader = pa.ipc.open_file(_Shifted(f, 8 + size))
        for i, r in enumerate(blocks):
            if r == wanted:
                yield from reader.get_batch(i).to_pylist()


class _Shifted(io.RawIOBase):
    """A file from ``start`` on."""

    def __init__(self, f, start: int):
        self.f, self.start = f, start
        f.seek(start)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        base = {0: self.start, 1: self.f.tell(), 2: self.f.size()}[whence]
        self.f.seek(base + at)
        return self.tell()

    def tell(self) -> int:
        return self.f.tell() - self.start

    def read(self, n: int = -1) -> bytes:
        return self.f.read(None if n is None or n < 0 else n)


def _captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to of each page."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    slim = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= least)
    copies = (
        slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
    )
    revisits = slim.join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    revisits = revisits.distinct()
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    match = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(revisits, match, "left").select("page_id", "url", "payload", "digest", "refers_to")


def _splits(pages: DataFrame, id_col: str, url_col: str) -> list[tuple]:
    """Borders of the key ranges, of about PER_RANGE captures each: every SAMPLE-th key of a sample."""
    total = pages.count()
    ranges = -(-total // PER_RANGE) + 1
    if total == 0 or ranges < 2:
        return []
    every = max(1, total // (ranges * SAMPLE))
    some = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"))
    some = some.where(F.pmod(F.xxhash64("i", "u"), F.lit(every)) == 0).limit(4 * ranges * SAMPLE).collect()
    keys = sorted((url_key(u), _date(i)[1], i is not None, i or 0) for i, u in some)
    step = len(keys) / ranges
    return sorted({keys[int(step * k)] for k in range(1, ranges) if keys})


def _date(page_id: int | None) -> tuple[str, str]:
    when = EPOCH + timedelta(seconds=(page_id or 0) % 2_000_000_000)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ"), when.strftime("%Y%m%d%H%M%S")


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = LEAST_PAYLOAD,
) -> DataFrame:
    """Write archives, runs and the merged index of ``pages`` into ``folder`` (a URI that executors reach).

    Returns the index: a row for each capture, in files that are in global order by (url_key, timestamp, id).
    """
    spark = pages.sparkSession
    ship(spark)
    splits = _splits(pages, id_col, url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, entries = [], 0, []
        done: list[tuple[str, int]] = []

        def close() -> None:
            name = uuid.uuid4().hex  # files of a task that failed are never named in the list of runs
            for e in entries:
                e["file"] = f"warc/{name}.warc.gz"
            _write(f"{folder}/warc/{name}.warc.gz", b"".join(parts))
            _write(f"{folder}/runs/{name}.run", _run_file(entries, splits))
            done.append((f"{folder}/runs/{name}.run", len(entries)))
            parts.clear()
            entries.clear()

        for batch in batches:
            for row in batch.to_pylist():
                long_date, short_date = _date(row["page_id"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = packer.compress(_record(row, row["digest"], row["payload"], long_date)) + packer.flush()
                entries.append({
                    "url_key": url_key(row["url"]), "timestamp": short_date, "page_id": row["page_id"], "url": row["url"],
                    "record_type": "response" if row["refers_to"] is None else "revisit", "refers_to": row["refers_to"],
                    "digest": row["digest"], "length": len(row["payload"]), "offset": size, "size": len(raw),
                })
                parts.append(raw)
                size += len(raw)
                if size >= FILE_BYTES or len(entries) >= ROLL_RECORDS:
                    close()
                    size = 0
        if entries:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["run", "entries"]
        )

    captures = _captures(pages, id_col, url_col, html_col, least)
    runs = [r["run"] for r in captures.mapInArrow(run, "run string, entries bigint").collect()]  # a row an archive file
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        runs = _merge_pass(spark, groups, folder, len(splits) + 1)
    return _merged(spark, runs, folder, len(splits) + 1)


def _merge_pass(spark: SparkSession, groups: list[list[str]], folder: str, ranges: int) -> list[str]:
    """Each group of runs becomes one run; a task merges one range of one group and writes as it goes."""
    name = uuid.uuid4().hex
    runs = [f"{folder}/runs/{name}-{k}/" for k in range(len(groups))]
    tasks = spark.createDataFrame(list(zip(runs, groups)), "run string, parts array<string>")
    tasks = tasks.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)).cast("array<bigint>"))).repartition(len(groups) * ranges, "run", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, group, r in zip(*(batch.column(c).to_pylist() for c in ("run", "parts", "id"))):
                system, path = fs.FileSystem.from_uri(f"{uri}{r}.run")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(own) as f, pa.ipc.new_file(f, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    for block in _blocks(LoserTree([_run_part(x, r) for x in group], _order)):
                        writer.write_batch(pa.RecordBatch.from_pylist(block, ENTRY))
                system.move(own, path)
            yield batch.select(["id"])

    tasks.mapInArrow(run, "id bigint").agg(F.count("*")).collect()
    return runs


def _blocks(rows) -> Iterator[list[dict]]:
    block: list[dict] = []
    for x in rows:
        block.append(x)
        if len(block) == BLOCK_ROWS:
            yield block
            block = []
    if block:
        yield block


def _merged(spark: SparkSession, runs: list[str], folder: str, ranges: int) -> DataFrame:
    """The loser-tree merge of each range, written as the index."""
    tasks = spark.range(0, ranges, 1, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                for block in _blocks(LoserTree([_run_part(x, r) for x in runs], _order)):
                    yield pa.RecordBatch.from_pylist(block, ENTRY)

    path = f"{folder}/index"
    tasks.mapInArrow(run, ENTRY_SQL).write.parquet(path)
    return spark.read.schema(ENTRY_SQL).parquet(path)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, read and verified: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for a revisit)."""
    ship(index.sparkSession)
    files = index.select("file", "offset", "size", "digest").groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("offset", "size", "digest"))).alias("places")
    )  # an archive file has at most ROLL_RECORDS records
    tasks = files.repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for task in batch.to_pylist():
                rows, held = [], 0
                system, path = fs.FileSystem.from_uri(f"{folder}/{task['file']}")
                with system.open_input_file(path) as f:
                    for p in task["places"]:
                        f.seek(p["offset"])
                        fields, block = parse_record(gzip.decompress(f.read(p["size"])))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError(f"a payload in {task['file']} is not what its headers say")
                        if digest != p["digest"]:
                            raise ValueError(f"a record in {task['file']} is not what the index says")
                        ids = [fields[k] and int(fields[k]) for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID") if k in fields]
                        ids = [None if x == "" else x for x in ids] + [None]
                        rows.append((ids[0], fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], ids[1], payload if whole else None))
                        held += length
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return tasks.mapInArrow(
        run,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back through the index."""
    folder = scratch_path(pages.sparkSession, "archive")
    return read_archive(write_archive(pages, folder), folder)
