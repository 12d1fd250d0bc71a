"""Vector expressions and hashed text vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import ship
from .text import STOP_WORDS

DIM = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Products summed over the shorter length."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is null, empty or zero; of unequal lengths the longer one's rest counts in its norm only."""
    size = norm(a) * norm(b)
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


#: Bytes of tokens as lower case, all others as blanks. Two letters outside ASCII have ASCII ones in their lower case.
_TOKEN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_LOWER_TO_ASCII = {"\u0130": "i\u0307", "\u212a": "k"}


def token_buckets(texts: pa.Array, dim: int = DIM) -> pa.Array:
    """``bucket`` of each of ``tokens`` of texts, in order, for workers: each distinct token of a batch is hashed once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for letter, lower in _LOWER_TO_ASCII.items():
        texts = pc.replace_substring(texts, letter, lower)
    _, offsets, data = texts.buffers()
    plain = np.frombuffer(_TOKEN_BYTES, np.uint8)[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(plain)], offset=texts.offset)
    cut = pc.ascii_split_whitespace(spaced)
    words = cut.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.large_binary())
    asked = pc.and_(pc.greater(pc.binary_length(known), 1), pc.invert(pc.is_in(known, pa.array([w.encode() for w in STOP_WORDS], pa.large_binary()))))
    digests = b"".join([hashlib.md5(w[:-1] if w[-1] == 115 and len(w) > 3 else w).digest() for w in known.filter(asked).to_pylist()])
    found = np.full(len(known), -1, np.int32)
    found[asked.to_numpy(zero_copy_only=False)] = np.frombuffer(digests, ">u4")[::4] % dim
    each = found[words.indices.to_numpy(zero_copy_only=False)]
    before = np.concatenate([[0], np.cumsum(each >= 0)])
    offsets = cut.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(before[offsets - offsets[0]].astype(np.int32)), pa.array(each[each >= 0]))


#: Bytes of words as they are, other ASCII ones as blanks; what isn't ASCII is looked at in distinct pieces.
_WORD_BYTES = bytes(c if c >= 128 or c == 95 or chr(c).isalnum() else 32 for c in range(256))


def distinct_words(texts: pa.Array) -> pa.Array:
    """The distinct words (letters, digits and _ of all scripts) of each text, for workers; none of no text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    plain = np.frombuffer(_WORD_BYTES, np.uint8)[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    cut = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(plain)], offset=texts.offset))
    pieces = cut.flatten().dictionary_encode()
    odd = pc.invert(pc.string_is_ascii(pieces.dictionary))
    cleaned = pc.replace_substring_regex(pieces.dictionary.filter(odd), r"[^\p{L}\p{N}_]+", " ")
    of_piece = pc.ascii_split_whitespace(pc.replace_with_mask(pieces.dictionary, odd, cleaned))
    words = of_piece.flatten().dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, n = of_piece.offsets.to_numpy(), of_piece.value_lengths().to_numpy(zero_copy_only=False)
    codes = pieces.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy(zero_copy_only=False)), n[codes])
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n[codes]) - n[codes], n[codes])
    word = ids[inside + np.repeat(first[codes] - first[0], n[codes])] if len(row) else np.zeros(0, np.int64)
    some = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[word] if len(row) else np.zeros(0, bool)
    each = np.sort(row[some] * max(1, len(words.dictionary)) + word[some])
    row, word = np.divmod(each[np.diff(each, prepend=-1) > 0], max(1, len(words.dictionary)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), words.dictionary.take(pa.array(word)).cast(pa.string()))


def word_sets(text: Column) -> Column:
    """The distinct lower-case words of a text, in Arrow batches."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.arrow_udf(distinct_words, "array<string>")(F.lower(text))


def buckets(text: Column, dim: int = DIM) -> Column:
    """The bucket of each token of a text: the sparse form of its vector of counts.

    In Arrow batches, as hashing every token anew in an expression costs many times what it does here.
    """
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.arrow_udf(lambda texts: token_buckets(texts, dim), "array<int>")(text)


def bucket_table(df: DataFrame, ids: list[str], text_col: str, dim: int = DIM) -> DataFrame:
    """(ids, bucket, tf): the sparse form, a row for each bucket a text has."""
    rows = df.select(*ids, F.explode(buckets(F.col(text_col), dim)).alias("bucket"))
    return rows.groupBy(*ids, "bucket").agg(F.count("*").alias("tf"))


def hashed_vectors(df: DataFrame, ids: list[str], text_col: str, dim: int = DIM) -> DataFrame:
    """(ids, vector): unit-length bucket counts of every row as array<double>, all zero without tokens."""

    @F.pandas_udf("array<double>")
    def dense(rows: pd.Series) -> pd.Series:
        counts = [np.bincount(np.asarray(b, np.int64), minlength=dim).astype(float) for b in rows]
        return pd.Series([c / (np.sqrt(c @ c) or 1.0) for c in counts])

    return df.select(*ids, dense(buckets(F.col(text_col), dim)).alias("vector"))
