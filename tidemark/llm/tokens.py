"""Whole texts to token ids, as the tokenizers library encodes them, with what repeats encoded once.

Some tokenizers (their normalizer lower-cases and makes blanks single, their splitter drops blanks) never
join text across what the splitter cuts. There numpy cuts the code points of many texts at once as the
splitter does, hashes each word, looks its ids up and compares the word itself; the library encodes words
that the worker has not met, many in a call. Words with a character on whose lower case, composition or class libraries may differ
go to the library one by one as they are; texts with a control or rare blank character or a special token,
and all texts of other tokenizers, go to it whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that send a text to the library whole.
ODD = r"[\x00-\x08\x0e-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Fixed: how the splitter that this module follows cuts words, and the endings in it that go with an apostrophe.
WORD_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS_1 = np.array([ord(x) for x in ("s", "t", "m", "d")])
ENDINGS_2 = np.array([ord(x[0]) << 16 | ord(x[1]) for x in ("re", "ve", "ll")])
#: Bytes of text that are worked on at once, code points cut at once, and words that a worker keeps.
STEP_BYTES, STEP_CHARS, KNOWN = 4_000_000, 150_000, 400_000


class PieceEncoder:
    """Ids of pieces of text, kept from call to call (at most ``known`` pieces); numpy puts texts together."""

    def __init__(self, known: int = KNOWN):
        self.known, self.slots = known, {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def encode_new(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Encode pieces into the slots after the kept ones."""
        found = self.encode_new(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        first = len(self.slots)
        while first + len(found) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[first : first + len(found)] = sizes
        self.starts[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        return np.arange(first, first + len(found))

    def gather(self, pieces: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has; text k is pieces[offsets[k]:offsets[k + 1]]."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        get = self.slots.get
        slot = np.fromiter((get(x, -1) for x in distinct), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        added: list[str] = []
        if len(new):
            added = [distinct[i] for i in new]
            slot[new] = self._add(added)
        codes = slot[coded.indices.to_numpy(zero_copy_only=False)]
        sizes, starts = self.sizes[codes], self.starts[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        if keep := max(0, min(len(added), self.known - len(self.slots))):  # the others are forgotten
            base = len(self.slots)
            self.slots.update(zip(added[:keep], range(base, base + keep)))
            self.used = int(self.starts[base + keep - 1] + self.sizes[base + keep - 1])
        upto = np.concatenate([[0], ends])
        offsets = offsets - offsets[0]
        return ids, upto[offsets[1:]] - upto[offsets[:-1]]


class KnownWords:
    """A hash table in numpy: at most ``known`` words, their code points by which a hit is verified, and the ids of each.

    Words of more than ``LONGEST`` code points, and what is beyond ``known * MEAN`` code points, are not kept.
    """

    LONGEST, MEAN = 256, 16

    def __init__(self, known: int):
        size = 1 << max(4, (2 * known).bit_length())
        self.known, self.mask, self.words = known, np.uint64(size - 1), 0
        self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.starts, self.sizes = np.zeros(known, np.int64), np.zeros(known, np.int32)
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0
        self.places, self.lengths = np.zeros(known, np.int64), np.zeros(known, np.int32)
        self.points, self.spelled = np.zeros(1 << 12, np.uint32), 0

    def find(self, keys: np.ndarray, points: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word points[first : first + length] (-1 where it is not known), and whether its key is taken."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        taken = out >= 0
        hit = np.flatnonzero(taken)
        slot = out[hit]
        same = self.lengths[slot] == lengths[hit]
        same[same] = equal_runs(self.points, self.places[slot[same]], points, first[hit[same]], lengths[hit[same]])
        out[hit[~same]] = -1
        return out, taken

    def add(self, keys: np.ndarray, points: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keep new words of distinct keys, spelled one after the other in ``points``, with their ids, as far as there is room."""
        room = np.searchsorted(np.cumsum(lengths), self.known * self.MEAN - self.spelled, "right")
        n = min(len(keys), self.known - self.words, int(room))
        if n <= 0:
            return
        keys, lengths, sizes = keys[:n], lengths[:n], sizes[:n]
        ids, points = ids[: int(sizes.sum())], points[: int(lengths.sum())]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.spelled + len(points) > len(self.points):
            self.points = np.concatenate([self.points, np.zeros_like(self.points)])
        slot = np.arange(self.words, self.words + n)
        self.starts[slot], self.sizes[slot] = self.used + np.cumsum(sizes) - sizes, sizes
        self.places[slot], self.lengths[slot] = self.spelled + np.cumsum(lengths) - lengths, lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.points[self.spelled : self.spelled + len(points)] = points
        self.used, self.spelled, self.words = self.used + len(ids), self.spelled + len(points), self.words + n
        left, at = np.arange(n), keys & self.mask
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of keys that meet here one stays, the others go on
            mine = free & (self.keys[at] == keys[left])
            self.slots[at[mine]] = slot[left[mine]]
            left, at = left[~mine], (at[~mine] + np.uint64(1)) & self.mask


def equal_runs(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[first : first + length] and b[first : first + length] are equal, for each (length over 0)."""
    if not len(lengths):
        return np.zeros(0, bool)
    starts = np.cumsum(lengths) - lengths
    steps = np.arange(int(starts[-1] + lengths[-1]))
    differ = a[np.repeat(a_first - starts, lengths) + steps] != b[np.repeat(b_first - starts, lengths) + steps]
    return ~np.logical_or.reduceat(differ, starts)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


#: Kinds of code points: blank, letter, number, other, and those whose words go to the library as they are.
BLANK, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Code points from here on are unsure but for the marks of these ranges: what is below lower-cases to one
#: code point, is composed already, and libraries agree on its class.
SURE, SURE_MARKS = 0x130, ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point up to 0x3000, which stands for all from there on."""
    kinds, lower = np.full(0x3001, UNSURE, np.uint8), np.arange(0x3001, dtype=np.uint32)
    for c in (*range(SURE), *(c for a, b in SURE_MARKS for c in range(a, b))):
        group = unicodedata.category(chr(c))[0]
        kinds[c] = BLANK if c in (9, 10, 11, 12, 13, 32) else {"L": LETTER, "N": NUMBER}.get(group, OTHER)
        lower[c] = ord(chr(c).lower())
    return kinds, lower


class TextEncoder:
    """Encodes Arrow string arrays with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = self._never_joins(config)
        self.vocabulary = self.library.get_vocab_size()
        self.special = "|".join(re.escape(x["content"]) for x in config["added_tokens"])
        if self.by_word:
            # For words that are normal already, with a blank between them.
            plain = config | {"normalizer": None, "added_tokens": []}
            plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, config["pre_tokenizer"]["pretokenizers"][-1]]}
            self.plain = Tokenizer.from_str(json.dumps(plain))
        self.words = KnownWords(known)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _never_joins(config: dict) -> bool:
        normalizers = (config.get("normalizer") or {}).get("normalizers", [])
        splitters = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        known = [x.get("type") if x != blanks else "blanks" for x in normalizers] == ["NFC", "blanks", "Lowercase"]
        split = {"type": "Split", "pattern": {"Regex": WORD_SPLITTER}, "behavior": "Removed", "invert": True}
        letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        return known and splitters == [split, letters] and not config.get("post_processor")

    def _units(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and end of each unit (what the splitter cuts, or an unsure word), whether it is unsure, its hash,
        and the code points by which units are told apart: lower case, but for unsure ones."""
        kinds, lower = _code_points()
        at = np.minimum(c, 0x3000)
        kind, low = kinds[at], np.where(c < 0x3000, lower[at], c)
        blank = kind == BLANK
        start = np.ones(len(c), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start &= ~blank
        # An apostrophe by itself takes some endings with it.
        quote = np.flatnonzero(start[:-1] & (c[:-1] == ord("'")) & (kind[1:] == LETTER))
        if len(quote):
            one, two = low[quote + 1], np.where(quote + 2 < len(c), low[np.minimum(quote + 2, len(c) - 1)], 0)
            taken = np.where(np.isin(one, ENDINGS_1), 1, np.where(np.isin(one << 16 | two, ENDINGS_2), 2, 0))
            quote, taken = quote[taken > 0], taken[taken > 0]
            start[quote + 1] = False
            after = quote + 1 + taken
            start[after[after < len(c)]] |= kind[after[after < len(c)]] == LETTER
        unsure = np.flatnonzero(kind == UNSURE)
        if len(unsure):
            first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
            which = np.unique(np.searchsorted(first, unsure, "right") - 1)
            inside = np.zeros(len(c) + 1, np.int8)
            inside[first[which]] = 1
            inside[end[which]] -= 1
            inside = np.cumsum(inside[:-1]).astype(bool)
            start[inside] = False
            start[first[which]] = True
            low = np.where(inside, c, low)
        first = np.flatnonzero(start)
        end = np.flatnonzero(~blank & np.concatenate([start[1:] | blank[1:], [True]])) + 1
        odd = inside[first] if len(unsure) else np.zeros(len(first), bool)
        self._reach(len(c))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * self.powers[: len(c)])])
        h = (total[end] - total[first]) * self.inverses[first] + ((end - first) << 1 | odd).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return first, end, odd, (h ^ (h >> np.uint64(29))) | np.uint64(1 << 63), low

    def _reach(self, n: int) -> None:
        """Powers of an odd number and of its inverse modulo 2 ** 64, up to n."""
        if n > len(self.powers):
            base = 0xD1342543DE82EF95
            self.powers, self.inverses = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            for x in (self.powers, self.inverses):
                x[0] = 1
                np.multiply.accumulate(x, out=x)

    def _encoded(self, c: np.ndarray, first: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that are not known, and how many each has."""
        lower, sizes, usual = _code_points()[1], np.zeros(len(first), np.int64), np.flatnonzero(~odd)
        plain, own = [], []
        for some in np.array_split(usual, -(-len(usual) // 20_000)) if len(usual) else []:
            long = end[some] - first[some] + 1  # with the character after it, made a blank
            ends = np.cumsum(long)
            flat = gathered(np.append(c, 32), first[some], long)
            flat[ends - 1] = 32
            flat = lower[flat].astype("<u4")
            lines = [flat[a:b].tobytes().decode("utf-32-le") for a, b in self._lines(ends)]
            found = self.plain.encode_batch(lines, add_special_tokens=False)
            plain += [np.array(x.ids, np.uint32) for x in found]
            sizes[some] = np.concatenate([np.bincount(np.array(x.word_ids, np.int64)) for x in found])
        for k in np.flatnonzero(odd).tolist():
            word = c[first[k] : end[k]].astype("<u4").tobytes().decode("utf-32-le")
            own.append(np.array(self.library.encode(word, add_special_tokens=False).ids, np.uint32))
            sizes[k] = len(own[-1])
        out, mine = np.zeros(int(sizes.sum()), np.uint32), np.repeat(odd, sizes)
        for where, ids in ((~mine, plain), (mine, own)):
            if ids:
                out[where] = np.concatenate(ids)
        return out, sizes

    @staticmethod
    def _lines(ends: np.ndarray, words: int = 500) -> list[tuple[int, int]]:
        cut = [0, *ends[words - 1 : -1 : words].tolist(), int(ends[-1])]
        return list(zip(cut, cut[1:]))

    def _by_words(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a run of code points, and for each unit where it begins and how many ids it has."""
        first, end, odd, keys, points = self._units(c)
        lengths = end - first
        slot, taken = self.words.find(keys, points, first, lengths)
        missing = np.flatnonzero(slot < 0)
        starts, sizes = self.words.starts[slot], self.words.sizes[slot].astype(np.int64)
        if not len(missing):
            return gathered(self.words.flat, starts, sizes), first, sizes
        new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
        at = missing[at]
        # Other words of the same key are encoded one by one and not kept.
        same = lengths[at][back] == lengths[missing]
        same[same] = equal_runs(points, first[at[back[same]]], points, first[missing[same]], lengths[missing[same]])
        back[~same] = len(new) + np.arange(int((~same).sum()))
        at = np.concatenate([at, missing[~same]])
        ids, n = self._encoded(c, first[at], end[at], odd[at])
        sizes[missing] = n[back]
        starts[missing] = self.words.used + (np.cumsum(n) - n)[back]
        out = gathered(np.concatenate([self.words.flat[: self.words.used], ids]), starts, sizes)
        keep = np.flatnonzero(~taken[at[: len(new)]] & (lengths[at[: len(new)]] <= KnownWords.LONGEST))
        ids = gathered(ids, (np.cumsum(n) - n)[keep], n[keep])
        self.words.add(new[keep], gathered(points, first[at[keep]], lengths[at[keep]]), lengths[at[keep]], n[keep], ids)
        return out, first, sizes

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        ids, counts, lo = [], np.zeros(len(texts), np.int64), 0
        while lo < len(c):
            hi = min(len(c), lo + STEP_CHARS)
            while hi < len(c) and c[hi] not in (10, 32):  # never within a word
                hi += 1
            own, first, sizes = self._by_words(c[lo:hi])
            ids.append(own)
            np.add.at(counts, np.searchsorted(text_ends, first + lo, "right"), sizes)
            lo = hi
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.ones(len(texts), bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, f"{ODD}|{self.special}" if self.special else ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for which, how in ((np.flatnonzero(~odd), self._plain), (np.flatnonzero(odd), self._whole)):
            if len(which):
                ids, sizes = how(texts.take(pa.array(which)).to_pylist())
                for k, x in zip(which, np.split(ids, np.cumsum(sizes)[:-1])):
                    out[k] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a vocabulary file."""
    return TextEncoder(path)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if len(sizes) > first:
        yield batch.slice(first)
