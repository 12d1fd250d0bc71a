"""The words of Arrow texts, and digests of words, for numpy code in tasks."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts one after the other; text k has words[offsets[k]:offsets[k + 1]]."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return flat.filter(full), before[offsets - offsets[0]]


def digests(words: pa.Array) -> np.ndarray:
    """128 bits of BLAKE2b of each word, as two columns of uint64; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
    found = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in spelled), "<u8").reshape(-1, 2)
    return found[coded.indices.to_numpy(zero_copy_only=False)]
