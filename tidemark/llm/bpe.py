"""Byte-level BPE encoding and decoding, by speculating and verifying.

Words (as the vocabulary's splitter cuts texts) that a worker has not met are first cut greedily, each
token the longest in the vocabulary that fits. A token sequence is what merging gives exactly if each
token encodes to itself and each two neighbours are compatible: undoing merges on either side of the
border, latest first, never meets a pair that merging would have joined earlier. All borders of all new
words are tested together with numpy; only words that fail are merged pair by pair.

Decoding puts tokens' bytes together and reads them as UTF-8, with U+FFFD for what is not UTF-8.

Edge cases: null or empty text has no ids; null ids decode to the empty text; texts of any length are
encoded whole; special tokens' strings in a text become their ids, as in the tokenizers library; rows
that repeat are encoded each; an empty table gives an empty result; other columns are kept, but one that
has the name of a result is replaced by it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import PieceEncoder, steps

#: Fixed: how the byte-level splitter cuts text. The second says the same for Python's faster module,
#: for texts without the characters (third) on whose class the modules differ.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
NOT_PLAIN = r"[\x00-\x08\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbeɐ-‏ -  -₟℀-\U0010ffff]"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Bytes of text worked on at once, and words that a worker keeps: words are objects here, so fewer than elsewhere.
BPE_STEP, BPE_KNOWN = 2_000_000, 120_000


def _token_bytes(config: dict) -> list[bytes]:
    """The bytes of each id, special tokens included."""
    letters, vocab, added = byte_letters(), config["model"]["vocab"], config["added_tokens"]
    out = [b""] * (max([*vocab.values(), *(x["id"] for x in added)]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token)
    for x in added:
        out[x["id"]] = x["content"].encode()
    return out


class ByteDecoder:
    """Decodes ids of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            all_bytes = _token_bytes(json.load(f))
        self.sizes = np.fromiter(map(len, all_bytes), np.int64, len(all_bytes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(all_bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)]
        return raw.tobytes().decode("utf-8", "replace")


class BytePairEncoder(PieceEncoder):
    """Encodes with a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, known: int = BPE_KNOWN):
        super().__init__(known)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, splitter = config["model"], config.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or config.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary of the kind this encoder reads")
        vocab = model["vocab"]
        self.bytes_of = _token_bytes(config)
        size = len(self.bytes_of)
        # Rank 0 for single bytes, then by merge: what has a lower rank was made earlier.
        self.rank, self.left, self.right = np.zeros(size, np.int64), np.arange(size), np.arange(size)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = k, i, j
            self.merged[i, j] = (k, t)
        keys = np.array([i << 32 | j for i, j in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([k for k, _ in self.merged.values()], np.int64)[order]
        self.ids = {b: i for token, i in vocab.items() if (b := self.bytes_of[i]) is not None}
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.itself = np.full(size, -1, np.int8)
        self.added = {x["content"]: x["id"] for x in config["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in config["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take blanks with them")
        names = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.specials = re.compile(f"({names})") if names else None
        self.plain, self.general, self.odd = re.compile(PLAIN_SPLITTER), regex.compile(SPLITTER), re.compile(NOT_PLAIN)

    def exact(self, raw: bytes) -> list[int]:
        """Ids of a word by merging: always the pair merged earliest in training, leftmost first."""
        ids = [self.single[b] for b in raw]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merged = self.merged
        heap = [(*merged[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merged]
        heap = [(k, i, t) for k, t, i in heap]
        heapq.heapify(heap)
        gone = bytearray(len(ids))
        while heap:
            k, i, t = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or merged.get((ids[i], ids[j])) != (k, t):
                continue
            ids[i], gone[j], after[i] = t, 1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if found := merged.get((t, ids[after[j]])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0 and (found := merged.get((ids[before[i]], t))):
                heapq.heappush(heap, (found[0], before[i], found[1]))
        return [t for t, x in zip(ids, gone) if not x]

    def greedy(self, raw: bytes) -> list[int]:
        """The longest token first, from left to right: a proposal."""
        out, at, n, get, longest = [], 0, len(raw), self.ids.get, self.longest
        while at < n:
            end = min(n, at + longest)
            while (t := get(raw[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between each two tokens as it is."""
        out = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.copy(), right.copy()
        limit = np.full(len(left), np.iinfo(np.int64).max)
        while len(live):
            keys = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            joined = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit)
            out[live[joined]] = False
            # Undo the later of the two sides' merges. A pair across the border as early as the left side's
            # merge came after it (merging goes left to right), one as early as the right side's before.
            first = self.rank[a] > self.rank[b]
            undo_a, undo_b = first & (self.rank[a] > 0), ~first & (self.rank[b] > 0)
            limit = np.where(undo_a, self.rank[a], np.where(undo_b, self.rank[b] + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            stay = ~joined & (undo_a | undo_b)
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return out

    def _itself(self, ids: np.ndarray) -> np.ndarray:
        """Whether each token's bytes encode to the token."""
        for t in np.unique(ids[self.itself[ids] < 0]).tolist():
            self.itself[t] = self.exact(self.bytes_of[t]) == [t]
        return self.itself[ids] == 1

    def encode_new(self, pieces: list[str]) -> list[list[int]]:
        special = self.added
        raw = [x.encode() for x in pieces]
        found = [[special[x]] if x in special else self.greedy(r) for x, r in zip(pieces, raw)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(found)), sizes)
        failed = np.zeros(len(found), bool)
        usual = np.array([x not in special for x in pieces], bool)
        failed[word[usual[word] & ~self._itself(np.where(usual[word], ids, self.single[0]))]] = True
        border = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(ids[border] << 32 | ids[border + 1], return_inverse=True)
        failed[word[border[~self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]]]] = True
        for i in np.flatnonzero(failed & usual).tolist():
            found[i] = self.exact(raw[i])
        return found

    def words(self, text: str) -> list[str]:
        find = (self.general if self.odd.search(text) else self.plain).findall
        if self.specials is None or not any(x in text for x in self.added):
            return find(text)
        return [w for x in self.specials.split(text) for w in ([x] if x in self.added else find(x))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        split = [self.words(x or "") for x in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        return self.gather(pa.array(chain.from_iterable(split), pa.string(), size=int(offsets[-1])), offsets)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> BytePairEncoder:
    """This worker's encoder for a vocabulary file."""
    return BytePairEncoder(path)


@lru_cache(maxsize=2)
def byte_decoder(path: str) -> ByteDecoder:
    """This worker's decoder for a vocabulary file."""
    return ByteDecoder(path)


def _schema(df: DataFrame, but: set[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in but] + [more])


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the text column given way to n_tokens (long) and ids (binary: little-endian unsigned 32-bit).

    ``decoded_col`` asks for a column with the text that the ids decode to, made by the same workers.
    """
    ship(docs.sparkSession)
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    made = ["n_tokens", "ids"] + ([decoded_col] if decoded_col else [])
    kept = [c for c in docs.columns if c not in (text_col, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, back = byte_encoder(vocabulary), byte_decoder(vocabulary) if decoded_col else None
        for batch in batches:
            for part in steps(batch, text_col, BPE_STEP):
                ids, sizes = bpe.encode(part.column(text_col))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
                rows = [raw[e - 4 * n : e] for e, n in zip(ends, sizes.tolist())]
                found = [pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())]
                if back:
                    found.append(pa.array([back.decode(np.frombuffer(x, "<u4")) for x in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found], [*kept, *made])
                del ids, raw, rows, found, part
                pa.default_memory_pool().release_unused()

    schema = _schema(docs, {text_col, *made}, "n_tokens bigint, ids binary" + (f", `{decoded_col}` string" if decoded_col else ""))
    return docs.select(*(F.col(f"`{c}`") for c in kept), f"`{text_col}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its column ``ids`` (as ``encode`` gives them) added."""
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_decoder(vocabulary)
        for batch in batches:
            for part in steps(batch, "ids", 2 * BPE_STEP):
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col]
                )

    return encoded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(
        run, _schema(encoded, {text_col}, f"`{text_col}` string")
    )
