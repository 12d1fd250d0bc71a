"""A content-addressed store of token ids: chunks cut by a rolling hash, kept once, with recipes and Merkle trees.

Writing. Each document's ids (and its end id) are cut where a hash of the last ``WINDOW`` ids has its low
bits zero, so equal passages give equal chunks wherever they stand. A chunk's address is a BLAKE2b
digest of its bytes. Files in the store folder:

- ``packs/``: each distinct chunk once, in the order in which a task met it. ``TMPK2``, then compressed blocks
  with their lengths; a block's chunks follow each other.
- ``index/``: Parquet: each chunk's digest, pack, the place of its block in the pack and its own in the block.
- ``recipes/``: documents in ascending id order, files in that order too. ``TMRC2`` + for each document its
  id, place, length, home pack (that of its first chunk that was new, else zeros), Merkle root and chunk digests.
- ``manifest.json``: element type, each recipe file's first place and Merkle root (over its documents'
  roots), and the root over them, which thus depends on every id of the store.

The workers that encode write the packs, so chunks' bytes are never shuffled. Chunks that several tasks met
are found by their digests; packs that hold one which another pack keeps are written again without it.

Reading joins recipes with the index by digest. Documents of one home pack go to one task, which reads that
pack in order and looks up the chunks that other packs hold. Digests of chunks and roots of documents are
computed again, and a difference is an error. Ids are little-endian, 16 bits wide if the vocabulary allows.

A task writes a file under a name of its own, then renames it, so a task that runs again does no harm; files
that the index doesn't name are leftovers of failed tasks.

Edge cases: null or empty text is its end id alone; null ids come first; rows of one id are documents of
their own, ordered by content; ids that are neither whole numbers nor strings become strings; an empty table
gives a store without documents; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release, scratch_path, with_text, written
from .tokens import encoder, gathered, steps

WINDOW, MASK_BITS, LEAST, MOST = 16, 8, 32, 2048
DIGEST = 20
PACK_BYTES, BLOCK_BYTES = 16_000_000, 256_000
PACK_MAGIC, RECIPE_MAGIC = b"TMPK2", b"TMRC2"
#: Bytes of a pack's name; blocks and files that a reading task keeps at hand; ids that one reads, about.
NAME, BLOCKS, FILES, READ_IDS = 16, 64, 16, 8_000_000
PLACE = "digest binary, pack binary, block bigint, at int, size int"


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd node goes up as it is. Inner nodes are marked apart from leaves."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: at least LEAST ids apart (but the last), at most MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    # Rolling polynomial hash of each window, by doubling: the hash of 2w ids is made from two of w ids.
    rolled, width, base = mixed, 1, 0xD6E8FEB86659FD93
    while width < WINDOW and len(rolled) > width:
        rolled = rolled[:-width] * np.uint64(base) + rolled[width:]
        width, base = width * 2, base * base & (1 << 64) - 1
    at = np.flatnonzero((rolled >> np.uint64(32)) & np.uint64((1 << MASK_BITS) - 1) == 0) + width
    out, last = [], 0
    for end in at.tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    out.append(n)
    return out


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, raw: bytes) -> None:
    """Write under another name, then rename: a file is there whole or not at all."""
    system, path = _opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as f:
        f.write(raw)
    system.move(own, path)


class PackWriter:
    """Writes chunks into pack files and tells where each is."""

    def __init__(self, folder: str, name: bytes):
        self.folder, self.name, self.press = folder, name, zstandard.ZstdCompressor(level=3)
        self.parts, self.size, self.block = [PACK_MAGIC], len(PACK_MAGIC), bytearray()

    def add(self, chunk: bytes) -> tuple[bytes, int, int, int]:
        """Pack, block, place in the block and length of a chunk that is now in the pack."""
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()
        place = (self.name, self.size, len(self.block), len(chunk))
        self.block += chunk
        return place

    def close_block(self) -> None:
        if self.block:
            small = self.press.compress(bytes(self.block))
            self.parts += [struct.pack("<I", len(small)), small]
            self.size += 4 + len(small)
            self.block.clear()

    def close(self) -> None:
        self.close_block()
        if len(self.parts) > 1:
            write_file(_pack(self.folder, self.name), b"".join(self.parts))


def _pack(folder: str, name: bytes) -> str:
    return f"{folder}/packs/{name.hex()}.pack"


class PackReader:
    """Chunks by their places, with the last blocks and files at hand."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, zstandard.ZstdDecompressor()
        self.blocks: OrderedDict[tuple, bytes] = OrderedDict()
        self.files: OrderedDict[bytes, object] = OrderedDict()

    def file(self, name: bytes):
        if name not in self.files:
            system, path = _opened(_pack(self.folder, name))
            self.files[name] = f = system.open_input_file(path)
            if f.read(len(PACK_MAGIC)) != PACK_MAGIC:
                raise ValueError("not a pack file")
            if len(self.files) > FILES:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name]

    def block(self, name: bytes, block: int) -> bytes:
        if (name, block) not in self.blocks:
            f = self.file(name)
            f.seek(block)
            (n,) = struct.unpack("<I", f.read(4))
            self.blocks[name, block] = self.open.decompress(f.read(n))
            if len(self.blocks) > BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end((name, block))
        return self.blocks[name, block]

    def close(self) -> None:
        for f in self.files.values():
            f.close()


_PLACE = pa.struct([("digest", pa.binary()), ("pack", pa.binary()), ("block", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])


def _chunked(docs: DataFrame, vocabulary: str, end_id: int, width: int, folder: str) -> DataFrame:
    """A row a document: doc_id, root, n_tokens, digests, home and the places of chunks that its task met first,
    which are in packs then."""
    element = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        met: set[bytes] = set()  # addresses that this task has given out, as far as it remembers
        pack = PackWriter(folder, uuid.uuid4().bytes)
        for batch in batches:
            for part in steps(batch):
                if len(met) > 500_000:
                    met.clear()
                columns: tuple[list, ...] = ([], [], [], [], [])
                for ids in encode(part.column("text")):
                    ids = np.append(ids, np.uint32(end_id))
                    raw, leaves, own, last = ids.astype(element).tobytes(), [], [], 0
                    for end in cuts(ids):
                        chunk = raw[last * width : end * width]
                        leaves.append(digest(chunk))
                        if leaves[-1] not in met:
                            met.add(leaves[-1])
                            own.append((leaves[-1], *pack.add(chunk)))
                        last = end
                    home = own[0][1] if own else bytes(NAME)
                    for column, x in zip(columns, (merkle(leaves), len(ids), b"".join(leaves), home, own)):
                        column.append(x)
                pack.close_block()
                if pack.size >= PACK_BYTES:
                    pack.close()
                    pack = PackWriter(folder, uuid.uuid4().bytes)
                types = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(_PLACE))
                found = [pa.array(x, t) for x, t in zip(columns[:-1], types)]
                found.append(_places(columns[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], ["doc_id", "root", "n_tokens", "digests", "home", "fresh"])
        pack.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, root binary, n_tokens bigint, digests binary, home binary, fresh array<struct<{PLACE}>>"
    )


def _places(rows: list[list[tuple]]) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(_PLACE)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_PLACE)))


def _settled(packs: DataFrame, folder: str) -> DataFrame:
    """``packs`` (pack, chunks: places in order, lost: those that another pack keeps). A pack that lost chunks is written
    again without them, block by block; returns the places of all chunks that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("pack").to_pylist()):
                chunks = batch.column("chunks")[k].values
                block, at, size, lost = (chunks.field(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "size", "lost"))
                stay = np.flatnonzero(~lost)
                keys = chunks.field("digest").take(pa.array(stay))
                block, at, size = block[stay], at[stay], size[stay]
                if lost.any():
                    old, new = PackReader(folder), PackWriter(folder, name + b"\1")
                    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
                    for first, end in zip(edges, edges[1:]):
                        some = slice(first, end)
                        raw = np.frombuffer(old.block(name, int(block[first])), np.uint8)
                        new.block += gathered(raw, at[some].astype(np.int64), size[some].astype(np.int64)).tobytes()
                        block[some], at[some] = new.size, np.cumsum(size[some]) - size[some]
                        new.close_block()
                    new.close()
                    old.close()
                    name = new.name
                names = pa.array([name] * len(stay), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys, names, pa.array(block, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                    ["digest", "pack", "block", "at", "size"],
                )

    return packs.mapInArrow(run, PLACE)


def _write_index(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Write the index of the packs' chunks, each kept once; returns how many chunks and packs there are."""
    places = rows.select(F.explode("fresh").alias("p")).select("p.*")
    # A chunk that every task met is a row a task here, not a row a document.
    first = Window.partitionBy("digest").orderBy("pack", "block", "at")
    marked = places.withColumn("lost", F.row_number().over(first) > 1)
    # A pack's chunks are bounded by its size.
    chunks = F.sort_array(F.collect_list(F.struct("block", "at", "size", "digest", "lost"))).alias("chunks")
    index = _settled(marked.groupBy("pack").agg(chunks), folder)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    index = rows.sparkSession.read.schema(PLACE).parquet(f"{folder}/index")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("pack").to_pylist():
                system, path = _opened(_pack(folder, name))
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
            yield batch

    replaced = places.select("pack").distinct().join(index.select("pack").distinct(), "pack", "left_anti")
    replaced.mapInArrow(drop, "pack binary").agg(F.count("*")).collect()
    return tuple(index.agg(F.count("*"), F.count_distinct("pack")).first())


def _doc_key(kind: str, value: object) -> bytes:
    raw = b"" if value is None else (struct.pack("<q", value) if kind == "bigint" else str(value).encode())
    return struct.pack("<i", -1 if value is None else len(raw)) + raw


def _write_recipes(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """``rows`` in order: a recipe file a partition, places counted from the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, n, roots, part = [], 0, 0, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for r in batch.to_pylist():
                body = struct.pack("<qqI", place, r["n_tokens"], len(r["digests"]) // DIGEST) + r["home"] + r["root"] + r["digests"]
                out.append(_doc_key(kind, r["doc_id"]) + body)
                place, n = place + r["n_tokens"], n + 1
                roots.append(r["root"])
        if n:
            write_file(f"{folder}/recipes/{part:08d}.recipe", RECIPE_MAGIC + b"".join(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([place], pa.int64()), pa.array([merkle(roots)], pa.binary())],
                ["part", "documents", "ids", "root"],
            )

    return rows.mapInArrow(run, "part int, documents bigint, ids bigint, root binary")


def write_store(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Write the store of ``docs`` into ``folder`` (a URI that executors reach); returns its manifest."""
    spark = docs.sparkSession
    width = 2 if encoder(vocabulary).vocabulary <= 1 << 16 else 4
    keys = with_text(docs, id_col, text_col)
    kind = keys.schema["doc_id"].dataType.simpleString()
    if kind not in ID_TYPES:
        kind = "bigint" if kind in ("tinyint", "smallint") else "string"
        keys = keys.withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = written(_chunked(keys, vocabulary, end_id, width, folder), "chunked")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    chunks, packs = _write_index(rows, folder)
    order = rows.select("doc_id", "root", "n_tokens", "digests", "home")
    parts = max(2, -(-total // 50_000_000))
    order = order.repartitionByRange(int(parts), "doc_id", "root").sortWithinPartitions("doc_id", "root")
    found = sorted(_write_recipes(order.withColumn("part", F.spark_partition_id()), folder, kind).collect())  # a row a file
    discard(rows)
    first, files = 0, []
    for r in found:
        files.append({"part": r["part"], "first": first, "documents": r["documents"], "ids": r["ids"], "root": r["root"].hex()})
        first += r["ids"]
    manifest = {
        "format": 1, "id_type": kind, "width": width, "ids": first, "documents": sum(x["documents"] for x in files),
        "chunks": chunks, "packs": packs, "recipes": files,
        "root": merkle([bytes.fromhex(x["root"]) for x in files]).hex(),
    }
    write_file(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit) of each document of a store."""
    system, path = _opened(f"{folder}/manifest.json")
    with system.open_input_stream(path) as f:
        manifest = json.loads(f.read())
    kind, width = manifest["id_type"], manifest["width"]
    roots = [bytes.fromhex(x["root"]) for x in manifest["recipes"]]
    if merkle(roots).hex() != manifest["root"]:
        raise ValueError("the manifest's root is not that of its recipe files")
    if not roots:
        return spark.createDataFrame([], f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
    files = {x["part"]: (x["first"], bytes.fromhex(x["root"])) for x in manifest["recipes"]}  # one a recipe file

    def parse_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                first, root = files[int(name.rsplit("/", 1)[1].split(".")[0])]
                yield from _parsed_recipe(memoryview(raw.as_buffer()), kind, first, root)

    parts = max(2, -(-manifest["ids"] // READ_IDS))
    recipes = spark.read.format("binaryFile").load(f"{folder}/recipes").select("path", "content")
    recipes = recipes.mapInArrow(parse_recipes, f"doc_id {kind}, start bigint, n_tokens bigint, home binary, root binary, digests binary")
    # Documents without a home, copies all through, go by their own place.
    alone = F.col("home") == F.lit(bytes(NAME))
    recipes = recipes.withColumn("route", F.when(alone, F.xxhash64("start")).otherwise(F.xxhash64("home")))
    heads = recipes.select("route", "start", F.lit(-1).alias("nth"), "doc_id", "n_tokens", "root")
    leaves = F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)
    leaf = lambda i: F.substring(F.col("digests"), i * DIGEST + 1, F.lit(DIGEST))
    chunks = recipes.select("route", "start", F.posexplode(F.transform(leaves, leaf)).alias("nth", "digest"))
    # A chunk that many documents hold is a hot key of this join only, which adaptive execution splits.
    found = chunks.join(spark.read.schema(PLACE).parquet(f"{folder}/index"), "digest")
    both = heads.unionByName(found, allowMissingColumns=True)
    both = both.repartition(int(parts), "route").sortWithinPartitions("route", "start", "nth")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, chunks = None, [], []
        done: list[tuple] = []
        packs = PackReader(folder)

        def close() -> None:
            doc, start, n, root = now
            ids = np.frombuffer(b"".join(chunks), f"<u{width}")
            if merkle(leaves) != root or len(ids) != n:
                raise ValueError(f"document {doc!r} at {start} does not verify")
            done.append((doc, start, n, ids.astype("<u4").tobytes()))

        def flushed() -> pa.RecordBatch:
            types = (ID_TYPES[kind], pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([x[i] for x in done], t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

        size = 0
        for batch in batches:
            nth = batch.column("nth").to_numpy()
            at = np.flatnonzero(nth < 0)
            heads = batch.select(["doc_id", "start", "n_tokens", "root"]).take(pa.array(at))
            heads = list(zip(*(heads.column(c).to_pylist() for c in range(4))))
            places = zip(*(batch.column(c).to_pylist() for c in ("digest", "pack", "block", "at", "size")))
            edges = [0, *at.tolist(), len(nth)]
            for k, (first, end) in enumerate(zip(edges, edges[1:])):
                if k:  # a document's own row, then its chunks; those before the first belong to the batch before
                    if now:
                        close()
                        size += now[2]
                        if size > 1_000_000:
                            size = 0
                            yield flushed()
                    now, leaves, chunks = heads[k - 1], [], []
                    next(places)
                    first += 1
                for key, name, block, place, length in islice(places, end - first):
                    chunk = packs.block(name, block)[place : place + length]
                    if digest(chunk) != key:
                        raise ValueError("a chunk is not what its address says")
                    leaves.append(key)
                    chunks.append(chunk)
        if now:
            close()
        packs.close()
        yield flushed()

    return both.mapInArrow(build, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _parsed_recipe(view: memoryview, kind: str, first: int, root: bytes) -> Iterator[pa.RecordBatch]:
    if bytes(view[: len(RECIPE_MAGIC)]) != RECIPE_MAGIC:
        raise ValueError("not a recipe file")
    at, roots, rows, held = len(RECIPE_MAGIC), [], [], 0
    types = (ID_TYPES[kind], pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["doc_id", "start", "n_tokens", "home", "root", "digests"]

    def flushed() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        rows.clear()
        return found

    while at < len(view):
        (size,) = struct.unpack_from("<i", view, at)
        raw = bytes(view[at + 4 : at + 4 + max(0, size)])
        at += 4 + len(raw)
        doc = None if size < 0 else (struct.unpack("<q", raw)[0] if kind == "bigint" else raw.decode())
        if kind == "int" and doc is not None:
            doc = int(doc)
        place, n, k = struct.unpack_from("<qqI", view, at)
        at += 20
        home, own = bytes(view[at : at + NAME]), bytes(view[at + NAME : at + NAME + DIGEST])
        at += NAME + DIGEST
        leaves = bytes(view[at : at + k * DIGEST])
        at += k * DIGEST
        if merkle([leaves[i : i + DIGEST] for i in range(0, len(leaves), DIGEST)]) != own:
            raise ValueError(f"the recipe of document {doc!r} does not verify")
        roots.append(own)
        rows.append((doc, first + place, n, home, own, leaves))
        held += k
        if held > 20_000:
            held = 0
            yield flushed()
    if merkle(roots) != root:
        raise ValueError("a recipe file's root is not the manifest's")
    yield flushed()


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read it back."""
    folder = scratch_path(docs.sparkSession, "store")
    write_store(docs, folder, vocabulary, end_id)
    release(docs.sparkSession)
    return read_store(docs.sparkSession, folder)
