"""Shared words by rows of bytes and lists, and words of odd texts."""

import re

import numpy as np
import pyarrow as pa

from tidemark.functions.vectors import distinct_words
from tidemark.operators import sharing


def test_rows_and_lists_count_shared_words(monkeypatch):
    monkeypatch.setattr(sharing, "SUMMED", 64)
    monkeypatch.setattr(sharing, "SUM_BYTES", 2000)
    rnd = np.random.default_rng(5)
    pick = lambda n, most: [sorted({f"k{int(x)}" for x in rnd.pareto(0.6, rnd.integers(0, most)) * 3 % 900}) for _ in range(n)]
    texts, asked = pick(150, 60), [*pick(40, 30), [], ["other"], [f"k{i}" for i in range(400)]]
    held = sharing._by_word(pa.array(texts, pa.list_(pa.string())))
    coded = pa.array([w for q in asked for w in q]).dictionary_encode()
    row, codes = np.repeat(np.arange(len(asked)), [len(q) for q in asked]), coded.indices.to_numpy()
    want = np.array([[len(set(q) & set(t)) for t in texts] for q in asked])
    for often in (1, 8, 75):
        monkeypatch.setattr(sharing, "OFTEN", often)
        block = sharing._Texts(*held, len(texts), coded.dictionary)
        for some in (slice(0, len(asked)), slice(0, 42)):
            mine = row < some.stop
            least = np.maximum(want[some].max(axis=1) - 1, 1)
            i, j, n = block.reaching(row[mine], codes[mine], least)
            got = np.zeros_like(want[some])
            got[i, j] = n
            assert (got == np.where(want[some] >= least[:, None], want[some], 0)).all()


def test_words_of_odd_texts():
    texts = [None, "", " ", "a_b c-d a_b", "\u00e9t\u00e9\u2014\u00e9t\u00e9 x\u00a0y", "e\u0301a", "\u65e5\u672c,\u8a9e \u0663\u2003z", "\u2019", "a\x00b\x0bc", "\u00bd\u216b!"]
    got = distinct_words(pa.array(texts)).to_pylist()
    assert [sorted(x) for x in got] == [sorted(set(re.findall(r"\w+", t or ""))) for t in texts]
    assert distinct_words(pa.array(texts).slice(3, 3)).to_pylist() == got[3:6] and distinct_words(pa.array([], pa.string())).to_pylist() == []
