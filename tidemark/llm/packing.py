"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Lengths go from 1 to the sequence length, so how many pieces have each length says all that packing
needs, and that histogram has a fixed size whatever the corpus. It is packed on the driver, in bulk:

1. Reduction (Martello and Toth): for each length, from the longest, the sets of at most three pieces
   that provably dominate every other way to fill a sequence around it are fixed for good.
2. Best-fit decreasing packs what is left; sequences of equal free room are handled together.

The outcome is rules "the a-th to b-th pieces of length L go to sequences s.. at offset o", at most a
few for each pair of lengths. Workers look up each piece's rule by its rank among pieces of its length;
ranks are counted per bucket and added up, so no length, however common, meets in one task.

Edge cases: a null or empty text is its end token alone, one piece of length 1; repeated rows are
pieces of their own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_text, written
from .tokens import encoder, steps

SEQUENCE = 2048
#: Pieces in a bucket of the ranking, about.
BUCKET = 50_000


class _Plan:
    """Rules as parallel lists: length, first rank, pieces, first sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.rules: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.rules.append((size, self.rank[size], n, sequence, offset))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, items: tuple[int, ...], n: int) -> None:
        """n new sequences, each with these items."""
        offset = 0
        for size in items:
            self.place(size, n, self.sequences, offset)
            offset += size
        self.sequences += n

    def smallest(self, n: int, but: int) -> list[int]:
        """The n smallest pieces left beside one of size ``but``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.left[size] - (size == but))
            if len(out) == n:
                break
        return out

    def largest(self, room: int, but: tuple[int, ...]) -> int:
        """The largest size at most ``room`` left beside the sizes ``but``; 0 if none."""
        for i in range(bisect_right(self.sizes, room) - 1, -1, -1):
            if self.left[self.sizes[i]] > but.count(self.sizes[i]):
                return self.sizes[i]
        return 0

    def best_pair(self, room: int) -> int:
        """No two pieces left that fit ``room`` together have a larger sum than this."""
        best, i, j = 0, 0, bisect_right(self.sizes, room) - 1
        while i <= j:
            both = self.sizes[i] + self.sizes[j]
            if both > room:
                j -= 1
            else:
                best = max(best, both)
                i += 1
        return best

    def dominating(self, size: int) -> tuple[int, ...] | None:
        """A set around a piece of this size that dominates all others, or None."""
        room = self.capacity - size
        small = self.smallest(3, size)
        if not small or small[0] > room:
            return (size,)
        mate = self.largest(room, (size,))
        if mate == room or len(small) < 2 or small[0] + small[1] > room:
            return (size, mate)
        if len(small) == 3 and sum(small) <= room:
            return None
        # At most two more pieces fit beside it.
        if mate >= self.best_pair(room):
            return (size, mate)
        third = self.largest(room - mate, (size, mate))
        if third and third >= self.largest(room // 2, (size,)):
            return (size, mate, third)  # of any two that fit, one is at most mate and the other at most third
        return None

    def reduce(self) -> None:
        for size in self.sizes[::-1]:
            while self.left[size] and (found := self.dominating(size)):
                self.fix(found, min(self.left[x] // found.count(x) for x in found))

    def best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

        for size in self.sizes[::-1]:
            while self.left[size]:
                at = bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    room, first, n = self.capacity, self.sequences, -(-self.left[size] // (self.capacity // size))
                    self.sequences += n
                each = min(room // size, self.left[size])
                used = min(n, self.left[size] // each)
                for k in range(each):
                    self.place(size, used, first, self.capacity - room + k * size)
                put(room - each * size, first, used)
                if n > used:
                    put(room, first + used, n - used)


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """The rules (length, first rank, pieces, first sequence, offset), sorted, and how many sequences there are."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    rules = np.array(sorted(p.rules), np.int64).reshape(-1, 5)
    return rules, p.sequences


def token_pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    capacity: int = SEQUENCE,
) -> DataFrame:
    """Each document's ids and ``end_id``, in pieces: doc_id, piece, start, length, ids_crc32."""
    keys = with_text(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in steps(batch):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for k, ids in enumerate(encode(part.column("text"))):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(raw), capacity)):
                        some = raw[start : start + capacity]
                        for column, x in zip(rows, (k, piece, start, len(some), zlib.crc32(some))):
                            column.append(x)
                found = [part.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    found + [pa.array(x, pa.int64()) for x in rows[2:]], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, order: list[str], length_col: str = "length", capacity: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset (long). ``pieces`` is read twice: give it as a table.

    ``order`` names columns that order pieces of one length; rows equal in all of them are alike.
    """
    length = F.col(length_col)
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    rules, _ = plan(counts, capacity)
    buckets = max(8, -(-sum(counts.values()) // BUCKET))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    per = dealt.groupBy(length_col, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        length.alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    local = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*order))
    ranked = (
        dealt.withColumn("_local", local)
        .join(per, (length == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_rank", F.col("_base") + F.col("_local") - 1)
        .drop("_length", "_b", "_bucket", "_base", "_local")
    )
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    key = rules[:, 0] << 44 | rules[:, 1] if len(rules) else np.zeros(0, np.int64)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "_rank"))
                at = np.searchsorted(key, size << 44 | rank, "right") - 1
                rest = [pa.array(rules[at, 3] + rank - rules[at, 1], pa.int64()), pa.array(rules[at, 4], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + rest, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.select(*names, "_rank").mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, vocabulary, end_id=end_id, capacity=capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "length", "ids_crc32"], capacity=capacity)
