"""Repeated passages against a plain version: planted, overlapping and periodic ones, copies, edges and both joins."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import substring_dedup as module
from tidemark.llm.substring_dedup import COVERS, cover, substring_dedup

SCHEMA = "doc_id long, text string, row string, name1 int, kept string, n_words string"


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    passages = [[str(rnd.randrange(500)) for _ in range(90)] for _ in range(6)] + [["a"] * 80, ["a", "b"] * 40]

    def text():
        words = [str(rnd.randrange(30)) for _ in range(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 4)):
            p, at = rnd.choice(passages), rnd.randrange(len(words) + 1)
            start = rnd.randrange(0, len(p) // 2)
            words[at:at] = p[start : start + rnd.randrange(20, len(p))]
        return rnd.choice([" ", "  ", "\n", " \t\x0b"]).join(words) + rnd.choice(["", " ", "\n"])

    made = [text() for _ in range(150)] + [None, "", " \n", "a " * 5000, "\x1c b c " * 40, "é 日本 " * 30]
    return made + rnd.choices(made, k=30)


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    residues = COVERS[period]
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


@pytest.mark.parametrize("window, broadcast", [(35, 1 << 25), (35, -1), (60, 1 << 25), (7, -1), (2, 1 << 25), (1, -1)])
def test_equals_plain_version(spark, texts, monkeypatch, window, broadcast):
    monkeypatch.setattr(module, "BROADCAST_BYTES", broadcast)
    rows = [(None if i % 17 == 0 else i // 2, t, "r", i, "k", "n") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = substring_dedup(table, window=window).select("row.*", "n_words", "n_removed", "kept").collect()
    assert all(r[2:6] == ("r", r[3], "k", "n") for r in got)  # the input's columns, whatever their names
    assert sorted((r[3], *r[6:]) for r in got) == [(i, *x) for i, x in enumerate(plain(texts, window))]


def test_a_match_at_any_two_alignments_is_found(spark):
    """One passage of exactly a window, at each pair of positions modulo the period in two texts."""
    period, _ = cover(35)
    passage = [f"p{i}" for i in range(35)]
    for shift in range(0, period, 4):
        texts = [" ".join([f"x{a}.{k}" for k in range(a)] + passage + [f"y{a}"]) for a in (shift, *range(period, 2 * period))]
        assert [x[1] for x in plain(texts, 35)] == [35] * len(texts)
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r["n_removed"] for r in substring_dedup(table).collect()} == {35}


def test_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    few = spark.createDataFrame([(1, None), (None, None), (2, "a b")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(few).collect()) == [(0, 0, ""), (0, 0, ""), (2, 0, "a b")]
