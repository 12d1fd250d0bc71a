"""Phrases against plain Python: languages, punctuation, overlaps, dropped phrases, ties, homes and edges."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations as module
from tidemark.llm.collocations import collocations

SCHEMA = "lang string, text string, n int, phrase string, home int, score string"


def plain(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {c: a for c, a in counts.items() if len(c[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in candidates.items():
        inside = {(lang, w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)}
        gone |= {c for c in inside if 100 * a >= share * counts[c]}
    found = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
            score, _, n_left, n_right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), n_left, n_right))
    return sorted(
        (lang, i, p.decode(), -a, n_left, n_right, totals[lang], -s)
        for lang, x in found.items() for i, (s, a, p, n_left, n_right) in enumerate(sorted(x)[:top], 1)
    )


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words, blanks = ["a", "B", "É", "the", "of", "x y", "日本", "q\x1cz ", "Z", "😀"], [" ", "  ", "\t", " ", ". ", ",", "\r\n", "\x0b", "! ?", ":"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(blanks) for _ in range(n))
    made = [(rnd.choice([None, "en", "und", ""]), None if i % 20 == 0 else text(rnd.randrange(0, 60))) for i in range(250)]
    return made + [("en", ""), ("en", " \n."), ("xx", "go on " * 3000), ("xx", "one two three")] + made[:20]


@pytest.mark.parametrize("homes", [100_000, 5])
@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 3}, {"top": 5, "least": 2}, {"longest": 2, "share": 10}])
def test_equals_plain_version(spark, rows, monkeypatch, homes, how):
    monkeypatch.setattr(module, "HOME_ROWS", homes)
    table = spark.createDataFrame([(*r, 1, "p", 2, "s") for r in rows], SCHEMA).repartition(3)
    want = plain(rows, **how)
    assert len(want) > 10 and sorted(map(tuple, collocations(table, **how).collect())) == want


def test_arithmetic_beyond_64_bits(spark):
    """Counts of 10^13: 1000000 a a passes 64 bits."""
    a, n_left, n_right = 10**13, 3 * 10**13, 2 * 10**13 + 1
    here = [(0, 0, "en", "x y", a), (0, 1, "en", "x", n_left), (0, 1, "en", "y", n_right)]
    kinds = "home long, kind int, lang string, phrase string, f long"
    found = spark.createDataFrame(here, kinds).coalesce(1).mapInArrow(module._scores(50, 5), "home long, lang string, phrase string, a long, l long, r long, score long")
    assert [r["score"] for r in found.collect()] == [1000000 * a * a // (n_left * n_right)]


def test_nothing(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(None, None, 1, "", 1, "")], SCHEMA)).collect() == []


def test_buckets_beyond_memory(spark, monkeypatch):
    """Half a million distinct windows in two buckets of a task that has 30 MB for DuckDB."""
    monkeypatch.setattr(module, "MEMORY", "30MB")
    table = spark.range(40_000).selectExpr("'en' AS lang", "concat('often met here, ', array_join(transform(sequence(1, 12), i -> substr(sha1(concat(id, 'x', i)), 1, 20)), ' ')) AS text")
    run = module._bucket_counts(3, 10, pass_rows=20_000)
    counted = module.pieces_of(table).mapInArrow(module._counted(3, 2), "bucket int, data binary").repartition(1).sortWithinPartitions("bucket")
    found = {(r["size"], r["phrase"]): r["f"] for r in counted.mapInArrow(run, module.COUNTS).where("size > 0").collect()}
    assert found == {(k, p): 40_000 for k, p in ((1, "often"), (1, "met"), (1, "here"), (2, "often met"), (2, "met here"), (3, "often met here"))}


def test_each(spark):
    """Rows of a key that batches cut apart come together."""
    import pyarrow as pa

    batches = [pa.record_batch({"k": pa.array(x, pa.int32())}) for x in ([1, 1, 2], [2], [], [2, 5])]
    assert [[v for b in rows for v in b["k"].to_pylist()] for rows in module.each(iter(batches), "k")] == [[1, 1], [2, 2, 2], [5]]
