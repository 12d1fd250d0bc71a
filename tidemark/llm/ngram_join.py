"""N-gram Jaccard join: all links between documents whose sets of word n-grams are similar enough, exactly.

1. Each text becomes its set of n-gram hashes (64 bits, chained from a digest of each word). Texts of equal sets are one set from here on, named
   by a digest of it; its first 64 bits are its key while candidates are sought.
2. Candidates. Sets are ordered globally, n-grams known to be frequent last, and two sets that link share
   one of their first ``n - ceil(t n) + 1`` (prefix filter; of the smaller set, one of still fewer). Those
   n-grams, each with its set's key, are the only rows that grow with the texts; they are shuffled once. Sets
   that share one make a group, and groups of the same sets are compared once, by parity sketches: the Hamming
   distance of two sketches is never more than the sets' difference, so a distance over the limit rules a
   link out, exactly. What is left is connected into classes; a link never leaves its class. Frequent n-grams
   are counted in all sets, in each task by counters of bounded size; they change costs, never results.
3. Prefix-tree join. The sets of a class are stored in a trie, in descending frequency, and walked once for
   all of them: overlaps of the shared path are counted once, and a subtree is left where, for every set,
   the overlap so far and what its lengths leave cannot reach the threshold. Leaves give exact links.
4. Links connect sets into components, named by the smallest document id.

Where an n-gram or class has more sets than a block, blocks are paired and each pair of blocks is a group
of its own, so groups in tasks are bounded and no pair is left out.

Edge cases: a text of fewer than n words is one n-gram, its whole word sequence; null and empty texts have
no set, no links, and are their own component; rows equal in id are one document, whose component holds
what any of its texts links with; a null id gets a null component and takes no part; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, ship, written
from .graph import Sets, components
from .tokens import steps
from .words import cut, digests

#: Bytes of text worked on at once, and those whose words are hashed at once.
STEP_BYTES, HASH_BYTES = 2_000_000, 1_000_000
#: Keys of sets and groups that a task remembers; what it meets again after them costs a row, no more.
REMEMBERED = 1_000_000


@dataclass(frozen=True)
class Join:
    """Two sets link when ``den`` * intersection >= ``num`` * union; a gram is ``n`` words."""

    n: int = 3
    num: int = 90
    den: int = 100
    #: Sets of one n-gram compared in a group, sets of a class joined in a group, and their n-grams.
    block: int = 4096
    class_block: int = 2000
    class_grams: int = 4_000_000
    #: Frequent n-grams known to workers (16 bytes each).
    frequent: int = 200_000
    #: One in so many groups is compared first.
    first_part: int = 16
    #: Rows up to which the table of classes is broadcast (some 60 bytes each); beyond it is a shuffled join.
    broadcast_rows: int = 1_000_000


_U = np.uint64
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (uint64) of each text. Only A-Z are lower-cased, blanks are ASCII's."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # A cast slice keeps its offsets, which may begin over 0: Arrow's ascii_lower then gives other bytes. take copies.
    texts = pc.ascii_lower(texts.take(np.arange(len(texts))))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + HASH_BYTES, "right")))
        out += _gram_sets(texts.slice(first, end - first), n)
        first = end
    return out


def _gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    spelled, upto = cut(texts)
    words = np.ascontiguousarray(digests(spelled)[:, 0])

    def chained(first: int, k: int, count: int) -> np.ndarray:
        h = np.full(count, k, _U)
        for i in range(k):
            h = _mixed(h * _U(0x9E3779B97F4A7C15) + words[first + i : first + i + count])
        return h

    grams = chained(0, n, len(words) - n + 1) if len(words) >= n else np.zeros(0, _U)
    out, upto = [], upto.tolist()
    for a, b in zip(upto, upto[1:]):
        own = np.sort(grams[a : b - n + 1]) if b - a >= n else chained(a, b - a, 1) if b > a else grams[:0]
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
    return out


def set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def parity_sketch(grams: np.ndarray) -> bytes:
    """A bit for each of 64 to 16,384 buckets, at least the set's size up to there: whether it holds an odd number."""
    bits = 1 << min(14, max(6, (len(grams) - 1).bit_length()))
    odd = np.bincount(((grams >> _U(9)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, words: int) -> np.ndarray:
    x = np.frombuffer(sketch, _U)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple]:
    """The columns ``keys`` (one value each) and ``names`` (arrays, lists of binary ones) of each run of rows of equal
    keys, of a stream sorted by them."""
    every = keys + names
    left: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [x.to_pylist() if pa.types.is_binary(x.type) else x.to_numpy() for x in (batch.column(c) for c in every)]
        if left:
            now = [a + b if isinstance(a, list) else np.concatenate([a, b]) for a, b in zip(left, now)]
        change = np.zeros(len(now[0]) - 1, bool)
        for c in now[: len(keys)]:
            change |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        for first, end in zip(at, at[1:]):
            yield (*(c[first] for c in now[: len(keys)]), *(c[first:end] for c in now[len(keys) :]))
        left = [c[at[-1] :] for c in now]
    if left:
        yield (*(c[0] for c in left[: len(keys)]), *left[len(keys) :])


class _Frequent:
    """The n-grams that many sets of a task hold: counters by a hash see all of them, those that pass a bound are listed."""

    def __init__(self, slots: int = 1 << 22, least: int = 8):
        self.counters, self.mask, self.least, self.total = np.zeros(slots, np.uint32), _U(slots - 1), least, 0
        self.listed = np.zeros(0, _U)
        self.new: list[np.ndarray] = []

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams >> _U(17)) & self.mask).astype(np.int64)

    def bound(self) -> int:
        """Well over what other n-grams of the same counter add up to."""
        return max(self.least, 4 * self.total // len(self.counters))

    def add(self, sets: list[np.ndarray]) -> None:
        grams = np.concatenate(sets) if sets else self.listed[:0]
        self.total += len(grams)
        slots = self._slots(grams)
        np.add.at(self.counters, slots, np.uint32(1))
        self.new.append(np.unique(grams[self.counters[slots] >= self.bound()]))
        if sum(map(len, self.new)) > 1_000_000:
            self.listed, self.new = np.unique(np.concatenate([self.listed, *self.new])), []

    def largest(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most so many n-grams and their counts, about."""
        grams = np.unique(np.concatenate([self.listed, *self.new]))
        counts = self.counters[self._slots(grams)].astype(np.int64)
        keep = np.lexsort((grams, -counts))[:most]
        keep = keep[counts[keep] >= self.bound()]
        return grams[keep], counts[keep]


def _described(docs: DataFrame, join: Join) -> DataFrame:
    """For each document (is_doc): doc_id, n, its set's name and key, and the sketch of a set that its task meets first;
    further rows have as key and n an n-gram that many texts of a task hold and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["is_doc", "doc_id", "n", "set_id", "key", "sketch"]
        met: set[int] = set()
        frequent = _Frequent()
        for batch in batches:
            for part in steps(batch, most=STEP_BYTES):
                sets = gram_sets(part.column("text"), join.n)
                ids = [set_id(x) if len(x) else None for x in sets]
                keys = [None if x is None else _key(x) for x in ids]
                new = []
                for key in keys:
                    new.append(key is not None and key not in met)
                    met.add(key)
                sketches = [parity_sketch(x) if fresh else None for x, fresh in zip(sets, new)]
                frequent.add([x for x, fresh in zip(sets, new) if fresh])
                if len(met) > REMEMBERED:
                    met.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([True] * len(sets)), part.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()),
                     pa.array(ids, pa.binary()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())], names,
                )
        grams, counts = frequent.largest(join.frequent)
        grams, counts = grams.view(np.int64), counts.astype(np.int32)
        none = [pa.nulls(len(grams), t) for t in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * len(grams), pa.bool_()), none[0], pa.array(counts), none[1], pa.array(grams), none[2]], names
        )

    return docs.mapInArrow(run, "is_doc boolean, doc_id bigint, n int, set_id binary, key bigint, sketch binary")


def _prefixes(docs: DataFrame, described: DataFrame, join: Join) -> DataFrame:
    """(gram, key, n) of the first n-grams of each set, once a task; n is negative where the n-gram is beyond those
    that the smaller of two linking sets shares, part is over 0 where an n-gram is known to be in over a block of sets."""
    counted = described.where("NOT is_doc").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "key").limit(join.frequent).toArrow()
    grams = rows["key"].to_numpy().astype(np.int64).view(_U)
    order = np.argsort(grams)
    pairs = grams[order], rows["n"].to_numpy().astype(np.int64)[order]
    known = docs.sparkSession.sparkContext.broadcast(pairs)  # at most ``frequent`` pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        met: set[int] = set()
        for batch in batches:
            for part in steps(batch, most=STEP_BYTES):
                columns: tuple[list, ...] = ([], [], [], [])
                for grams in gram_sets(part.column("text"), join.n):
                    n = len(grams)
                    if not n or (key := _key(set_id(grams))) in met:
                        continue
                    met.add(key)
                    weight = np.zeros(n, np.int64)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                        weight = np.where(frequent[at] == grams, counts[at], 0)
                    k = n - -(-join.num * n // join.den) + 1
                    small = n - -(-2 * join.num * n // (join.den + join.num)) + 1
                    best = np.argsort(weight, kind="stable")[:k]
                    size = np.full(k, n, np.int32)
                    size[small:] = -n
                    salt = np.where(weight[best] > join.block, 1 + key % np.maximum(1, weight[best] // join.block + 1), 0)
                    for column, x in zip(columns, (grams[best].view(np.int64), np.full(k, key), size, salt.astype(np.int32))):
                        column.append(x)
                if len(met) > REMEMBERED:
                    met.clear()
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["gram", "key", "n", "part"])

    rows = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "gram bigint, key bigint, n int, part int")
    return rows.repartition("gram", "part").sortWithinPartitions("gram", "part", "key")


def _shared(rows: DataFrame, join: Join) -> DataFrame:
    """Of ``_prefixes``: (kind, group, key) for sets that share an n-gram. Kind 0: the group is named by its sets, so
    that equal groups are one; kind 1: the n-gram has more than a block of sets, its rows go on one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        out: tuple[list, ...] = ([], [], [])
        held = 0

        def flushed() -> pa.RecordBatch:
            types = (np.int8, np.int64, np.int64)
            found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(out, types)], ["kind", "group", "key"])
            for c in out:
                c.clear()
            return found

        def send(kind: int, group: int, keys: np.ndarray) -> int:
            for c, x in zip(out, (np.full(len(keys), kind), np.full(len(keys), group), keys)):
                c.append(x)
            return len(keys)

        def settle(gram: np.ndarray, part: np.ndarray, key: np.ndarray, n: np.ndarray, going_on: bool) -> int:
            """Send on whole groups, sorted; ``going_on``: rows of the first went on as rows of a large one."""
            sent = 0
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
            again = np.zeros(len(gram), bool)
            again[1:] = ~fresh[1:] & (key[1:] == key[:-1])  # a set that several tasks gave
            gram, part, key, n, fresh = (x[~again] for x in (gram, part, key, n, fresh))
            edges = np.append(np.flatnonzero(fresh), len(gram))
            sizes = np.diff(edges)
            first = edges[:-1]
            if going_on:
                sent += send(1, int(gram[0]), key[: edges[1]])
                first, sizes = first[1:], sizes[1:]
            two = first[(sizes == 2) & (part[first] == 0)]
            if len(two):
                a, b = np.abs(n[two]).astype(np.int64), np.abs(n[two + 1]).astype(np.int64)
                near = join.den * np.minimum(a, b) >= join.num * np.maximum(a, b)
                near &= ((a <= b) & (n[two] > 0)) | ((b <= a) & (n[two + 1] > 0))
                both = np.stack([key[two[near]], key[two[near] + 1]], axis=1)
                both = np.unique(both, axis=0) if len(both) else both
                names = _mixed(_mixed(both[:, 0].view(_U)) + both[:, 1].view(_U)).view(np.int64)
                new = np.array([x not in met for x in names.tolist()], bool)
                met.update(names.tolist())
                both, names = both[new], names[new]
                for c, x in zip(out, (np.zeros(2 * len(both)), np.repeat(names, 2), both.ravel())):
                    c.append(x)
                sent += 2 * len(both)
            for at, size in zip(*(x[(sizes > 2) | ((sizes > 0) & (part[first] > 0))].tolist() for x in (first, sizes))):
                own = key[at : at + size]
                if size > join.block or part[at] > 0:
                    sent += send(1, int(gram[at]), own)
                elif (n[at : at + size] > 0).any():
                    lengths = np.abs(n[at : at + size]).astype(np.int64)
                    order = np.argsort(lengths, kind="stable")
                    near = join.den * lengths[order[:-1]] >= join.num * lengths[order[1:]]
                    own = own[np.sort(order[np.append(near, False) | np.append(False, near)])]  # the others have no partner
                    if len(own):
                        name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                        if name not in met:
                            met.add(name)
                            sent += send(0, name, own)
            if len(met) > REMEMBERED:
                met.clear()
            return sent

        left, open_ = [np.zeros(0, np.int64)] * 4, None  # the last group so far; the group whose rows went on already
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(left, ("gram", "part", "key", "n"))]
            gram, part = now[0], now[1]
            other = np.flatnonzero((gram != gram[-1]) | (part != part[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            going_on = (int(gram[0]), int(part[0])) == open_
            if last:
                held += settle(*(x[:last] for x in now), going_on)
            left = [x[last:] for x in now]
            if len(left[0]) > join.block or (going_on and not last):
                held += send(1, int(gram[-1]), left[2])
                left, open_ = [x[:0] for x in left], (int(gram[-1]), int(part[-1]))
            if held > 100_000:
                held = 0
                yield flushed()
        if len(left[0]):
            settle(*left, False)
        yield flushed()

    return rows.mapInArrow(run, "kind tinyint, group bigint, key bigint")


def _dealt(rows: DataFrame, blocks: str, by: str) -> DataFrame:
    """Each row in each pair of blocks that its own block is part of: adds block, bi, bj. One block: one row."""
    own = F.pmod(F.xxhash64(by), F.col(blocks)).cast("int")
    rows = rows.withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", blocks)


def _spanning(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the groups in ``rows`` (group, key, ...) those that have keys of several classes."""
    of = rows.select("group", "key").join(classes, F.col("key") == F.col("node"), "left")
    of = of.select("group", F.coalesce("component", "key").alias("c")).groupBy("group").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return rows.join(of.where("low <> high").select("group"), "group", "left_semi")


def _candidate_edges(docs: DataFrame, described: DataFrame, join: Join) -> DataFrame:
    """Edges between keys that connect, in each group of sets sharing a first n-gram, those that sketches don't rule out.

    Near copies share many n-grams, in as many groups that differ by a set or two. A part of the groups connects most
    of them; then only groups that still have sets of several classes are compared.
    """
    shared = written(_shared(_prefixes(docs, described, join), join), "shared")
    release(docs.sparkSession)
    sketches = described.where("sketch IS NOT NULL").select("key", "n", "sketch").dropDuplicates(["key"])
    whole = shared.where("kind = 0").select("group", "key").distinct()
    none = F.lit(0).cast("int")
    whole = whole.withColumns({"block": none, "bi": none, "bj": none})
    large = shared.where("kind = 1").select("group", "key").distinct()
    sizes = large.groupBy("group").agg(F.ceil(F.count("*") / join.block).alias("blocks"))
    every = written(whole.unionByName(_dealt(large.join(sizes, "group"), "blocks", "key")), "groups")
    discard(shared)
    first = F.pmod(F.xxhash64("group"), F.lit(join.first_part)) == 0
    edges = written(_compared(every.where(first), sketches, join), "candidates")
    rest = _spanning(every.where(~first), components(edges))
    more = written(_compared(rest, sketches, join), "candidates")
    discard(every)
    return edges.unionByName(more)


def _compared(rows: DataFrame, sketches: DataFrame, join: Join) -> DataFrame:
    """Edges between keys of a group that sketches don't rule out, but for those whose keys are connected anyway."""
    rows = rows.join(sketches, "key")
    rows = rows.repartition("group", "bi", "bj").sortWithinPartitions("group", "bi", "bj", "n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, out = Sets(), []
        for _, bi, bj, block, key, size, raw in _runs(batches, ["group", "bi", "bj"], ["block", "key", "n", "sketch"]):
            if len(key) < 2:
                continue
            keys = key.tolist()
            tops = np.array([sets.top(x) for x in keys])
            if (tops == tops[0]).all():
                continue
            size, width = size.astype(np.int64), np.array([len(x) // 8 for x in raw])
            # Rows are sorted by size, so by the sketches' width too: each is compared at its own width with what follows.
            first = {w: int(np.searchsorted(width, w)) for w in np.unique(width).tolist()}
            end = {w: int(np.searchsorted(join.num * size, join.den * size[np.searchsorted(width, w, "right") - 1], "right")) for w in first}
            sketches = {w: np.array([_folded(x, w) for x in raw[first[w] : end[w]]]) for w in first}
            for i in range(len(keys) - 1):
                rest = np.flatnonzero(tops[i + 1 :] != tops[i]) + i + 1
                if bi != bj:
                    rest = rest[block[rest] != block[i]]
                rest = rest[join.den * size[i] >= join.num * size[rest]]  # sorted by size
                if not len(rest):
                    continue
                own, at = sketches[width[i]], first[width[i]]
                apart = np.bitwise_count(own[rest - at] ^ own[i - at]).sum(axis=1, dtype=np.int64)
                near = (join.den + join.num) * apart <= (join.den - join.num) * (size[rest] + size[i])
                for j in rest[near].tolist():
                    if sets.join(keys[i], keys[j]):
                        out.append((keys[i], keys[j]))
                if near.any():
                    tops = np.array([sets.top(x) for x in tops.tolist()])
            if len(out) > 50_000:
                yield _pairs(out)
        yield _pairs(out)

    return rows.select("group", "bi", "bj", "block", "key", "n", "sketch").mapInArrow(run, "a bigint, b bigint")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
    out.clear()
    return found


class PrefixTree:
    """A trie of sets, ranked by descending frequency, walked once against all probes. See the module's text."""

    def __init__(self, sets: list[np.ndarray], probes: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        grams, counts = np.unique(np.concatenate([*sets, *probes]), return_counts=True)
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
        ranked = lambda x: np.sort(rank[np.searchsorted(grams, x)])
        self.sets = [ranked(x) for x in sets]
        self.order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.sizes = np.array([len(self.sets[i]) for i in self.order], np.int64)
        self.shared = np.zeros(len(sets) + 1, np.int64)
        for k in range(1, len(sets)):
            a, b = self.sets[self.order[k - 1]], self.sets[self.order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared[k] = differ[0] if len(differ) else n
        # For each rank the probes that hold it.
        held = np.concatenate([ranked(x) for x in probes])
        owner = np.repeat(np.arange(len(probes)), [len(x) for x in probes])
        order = np.argsort(held, kind="stable")
        self.owners = owner[order]
        self.first = np.searchsorted(held[order], np.arange(len(grams) + 1))
        self.probe_sizes = np.array([len(x) for x in probes], np.int64)
        self.overlap = np.zeros(len(probes), np.int64)

    def _count(self, ranks: np.ndarray) -> np.ndarray:
        first, sizes = self.first[ranks], self.first[ranks + 1] - self.first[ranks]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(total)
        return np.bincount(self.owners[at], minlength=len(self.overlap))

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, the probes that link with it), both as indices; a set in both roles links with itself too."""
        num, den = self.num, self.den
        stack: list[tuple] = [("visit", 0, len(self.order), 0)] if self.order else []
        while stack:
            step = stack.pop()
            if step[0] == "undo":
                self.overlap -= step[1]
                continue
            _, lo, hi, depth = step
            own = self.sets[self.order[lo]]
            common = len(own) if hi - lo == 1 else int(self.shared[lo + 1 : hi].min())
            if common > depth:
                added = self._count(own[depth:common])
                self.overlap += added
                stack.append(("undo", added))
            least, most = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
            reach = self.overlap + np.minimum(most - common, self.probe_sizes - self.overlap)
            alive = (den + num) * reach >= num * (self.probe_sizes + least)
            if not alive.any():
                continue
            if hi - lo == 1:
                yield self.order[lo], np.flatnonzero((den + num) * self.overlap >= num * (self.probe_sizes + least))
                continue
            cut = [lo, *(np.flatnonzero(self.shared[lo + 1 : hi] == common) + lo + 1).tolist(), hi]
            stack += [("visit", a, b, common) for a, b in zip(cut, cut[1:])]


def _class_links(classes: DataFrame, docs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Exact links of each class: rows (a, b, null) connect what links, rows (a, null, links) count links."""
    members = sets.join(classes, sets["key"] == classes["node"])
    per = members.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("grams"))
    per = per.withColumn("blocks", F.greatest(F.ceil(F.col("c") / join.class_block), F.ceil(F.col("grams") / join.class_grams)))
    wanted = members.join(per.select("component", "blocks"), "component").select("set_id", "rep", "copies", "component", "blocks")
    wanted = written(wanted, "classes")
    small = wanted.count() <= join.broadcast_rows
    rows = docs.join(F.broadcast(wanted) if small else wanted, docs["doc_id"] == wanted["rep"])
    kept = ["component", "blocks", "set_id", "copies"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=STEP_BYTES):
                found = gram_sets(part.column("text"), join.n)
                mine = [k for k, (x, y) in enumerate(zip(found, part.column("set_id").to_pylist())) if len(x) and set_id(x) == y]
                raw = pa.array([found[k].tobytes() for k in mine], pa.binary())
                mine = pa.array(mine, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(mine) for c in kept), raw], [*kept, "grams"])

    # Each set is made once; what a large class repeats in its pairs of blocks is the set, not the text.
    rows = rows.select(*kept, "text").mapInArrow(sets_of, "component bigint, blocks bigint, set_id binary, copies bigint, grams binary")
    rows = _dealt(rows, "blocks", "set_id")
    rows = rows.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[bytes, bytes]] = []
        counts: list[tuple[bytes, int]] = []
        for _, bi, bj, block, copies, names, raw in _runs(batches, ["component", "bi", "bj"], ["block", "copies", "set_id", "grams"]):
            here = np.array([k for k in range(len(names)) if not k or names[k] != names[k - 1]])  # rows given twice
            left = here[block[here] == bi]
            right = left if bi == bj else here[block[here] == bj]
            if not len(left) or not len(right):
                continue
            sets, total = Sets(), np.zeros(len(names), np.int64)
            grams = [np.frombuffer(x, _U) for x in raw]
            for i, found in PrefixTree([grams[k] for k in left], [grams[k] for k in right], join.num, join.den).links():
                me, others = left[i], right[found]
                others = others[others != me]
                total[me] += copies[others].sum()
                if bi != bj:
                    np.add.at(total, others, copies[me])
                for k in others.tolist():
                    if sets.join(int(me), k):
                        edges.append((names[me], names[k]))
            counts += [(names[k], int(total[k])) for k in np.flatnonzero(total)]
            if len(edges) + len(counts) > 100_000:
                yield _linked(edges, counts)
        yield _linked(edges, counts)

    return rows.select("component", "bi", "bj", "block", "copies", "set_id", "grams").mapInArrow(run, "a binary, b binary, links bigint")


def _linked(edges: list[tuple[bytes, bytes]], counts: list[tuple[bytes, int]]) -> pa.RecordBatch:
    a = [x[0] for x in edges] + [x[0] for x in counts]
    b = [x[1] for x in edges] + [None] * len(counts)
    links = [None] * len(edges) + [x[1] for x in counts]
    edges.clear()
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((a, pa.binary()), (b, pa.binary()), (links, pa.int64()))], ["a", "b", "links"])


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join | None = None
) -> DataFrame:
    """doc_id, n_shingles (long), component_id (long), n_links (long) of each row of ``docs``.

    ``n_links`` counts the other rows, copies included, that the document links with directly.
    """
    join = join or Join()
    ship(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    described = written(_described(docs, join), "described")
    every = described.where("is_doc").select("doc_id", "n", "set_id", "key")
    real = every.where("n > 0 AND doc_id IS NOT NULL")
    # Summed in each task first: a set that a third of the corpus has is one row a task.
    sets = real.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("key").alias("key"), F.first("n").alias("n"))
    sets = written(sets, "sets")
    edges = _candidate_edges(docs, described, join)
    release(docs.sparkSession)
    links = written(_class_links(components(edges), docs, sets, join), "links")
    # An id with several texts holds their components together.
    by_doc = real.groupBy("doc_id").agg(F.min("set_id").alias("b"), F.max("set_id").alias("last"))
    several = by_doc.where("b <> last").select("doc_id", "b").join(real, "doc_id").where("set_id <> b")
    edges = links.where("b IS NOT NULL").select("a", "b").unionByName(several.select(F.col("set_id").alias("a"), "b"))
    found = components(edges)
    names = found.join(sets, F.col("node") == F.col("set_id")).groupBy("component").agg(F.min("rep").alias("name"))
    found = found.join(names, "component").select(F.col("node").alias("set_id"), "name")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    top = sets.join(found, "set_id", "left").join(counts, "set_id", "left")
    top = top.select("set_id", F.coalesce("name", "rep").alias("name"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # A row without a set has the component of its id's other rows, if there are any.
    bare = every.where("n = 0").select("doc_id", "n").join(by_doc.select(F.col("doc_id").alias("_id"), "b"), F.col("doc_id") == F.col("_id"), "left")
    rows = every.where("n > 0").select("doc_id", "n", "set_id").unionByName(bare.select("doc_id", "n", F.col("b").alias("set_id")))
    no_id = F.col("doc_id").isNull()
    return rows.join(top, "set_id", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(~no_id, F.coalesce("name", "doc_id")).alias("component_id"),
        F.when(no_id | (F.col("n") == 0), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
