"""The training-data operators against brute force, round trips, held-out labels and SQL, edge cases included."""

import glob
import os
import random
import re
import zlib
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, language_id, ngram_join, packing, quality_classifier, token_store, warc
from tidemark.llm.common import scratch_path
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import Join
from tidemark.llm.quality_rules import base_counts, quality_rules
from tidemark.llm.queries import QUERIES, SQL, tokenizer_file
from tidemark.llm.tokens import TextEncoder

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words int, node string, ids string, c int"
LONG = "word " * 30_000
EDGES = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a"), (5, "a b"), (6, "Same text here again and again."), (6, "Same text here again and again."), (None, "no id at all"), (7, LONG)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_file(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    key = lambda names, r: repr(sorted(zip(names, r)))
    names, columns = list(want.columns), df.columns
    assert sorted(key(columns, tuple(r)) for r in df.collect()) == sorted(key(names, r) for r in want.fetchall())


def brute_lines(rows, window=3, long_line=50):
    """Line dedup, plainly: {(id, text): text left}."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        full = [(k, re.sub(r"[\x20\x09-\x0d]+$", "", x)) for k, x in enumerate(lines)]
        full = [(k, x) for k, x in full if x]
        width, gone, new = min(window, len(full)), set(), set()
        windows = [full[k : k + width] for k in range(len(full) - width + 1)] if full else []
        windows += [[x] for x in full if width > 1 and len(re.findall(r"[^\x20\x09-\x0D]+", x[1])) > long_line]
        for some in windows:
            body = tuple(x for _, x in some)
            if body in seen or body in new:
                gone |= set(range(some[0][0], some[-1][0] + 1))
            new.add(body)
        seen |= new
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


def test_line_dedup(spark, monkeypatch):
    random.seed(1)
    passage = [f"word{k} " * 51 for k in range(4)]
    lines = ["a", "b", "c", "", "d ", "e", "f", *passage]
    rows = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(1, 9)))) for i in range(60)] + EDGES
    for long_line in (50, 51):
        monkeypatch.setattr("tidemark.llm.line_dedup.BROADCAST_BYTES", 32_000_000 * (long_line - 50))
        got = line_dedup(docs(spark, rows), long_line=long_line)
        assert set(docs(spark, rows).columns) < set(got.columns)
        want = brute_lines(rows, long_line=long_line)
        found = got.select("doc_id", "text", "n_removed").collect()
        assert sorted(repr((r["doc_id"], r["text"])) for r in found) == sorted(repr((i, want[i, t])) for i, t in rows)
    assert line_dedup(docs(spark, [])).count() == 0


def test_quality_base_counts(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choice(["x", "y", "z", "#*", "é|", "w\n", "w\nw\n"]) for _ in range(random.randint(0, 40)))) for i in range(50)] + EDGES

    def brute(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {p + j for p, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 1000 else set(range(len(w)))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))

    got = base_counts(docs(spark, rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in got.collect():
        assert tuple(r)[2:] == brute(r["text"]), r["text"]
    assert {r["words"] for r in base_counts(docs(spark, rows)).collect()} == {1}
    assert base_counts(docs(spark, rows)).where("NOT base_failed AND n_repeat_words < 5").count() >= 0
    clash = docs(spark, rows).selectExpr("*", "1 AS common", "2 AS class_q", "3 AS _lang", "4 AS lang_", "5 AS kept", "6 AS base")
    kept = quality_rules(clash)
    assert kept.where("common = 1 AND class_q = 2 AND _lang = 3 AND base = 6 AND words = 1").count() == len(rows)
    assert dict(kept.dtypes)["kept"] == "boolean"
    assert kept.count() == len(rows) and quality_rules(docs(spark, [])).count() == 0


def fuzz():
    random.seed(3)
    pool = "aeiou thnsr ABC.,!?0123\n\tééßİıΣσ日本🙂'\xa0²½_|#"
    texts = ["", " ", "a  b\n\n c", "don't stop.", "<|endoftext|>x y<|startoftext|>.", "ΑΣ ΑΣ. İs", "a\x1cb \x85 c", "x" * 3000, "aaaa" * 50]
    return texts + ["".join(random.choice(pool) for _ in range(random.randint(1, 60))) for _ in range(1500)]


def test_bpe_equals_library(library):
    path = tokenizer_file("byte_bpe_50k.json")
    encoder, decoder, texts = bpe.BytePairEncoder(path, known=500), bpe.ByteDecoder(path), fuzz()
    for _ in range(2):  # with words met before, too
        ids, sizes = encoder.encode(pa.array(texts))
        for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            want = library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
            assert list(own) == want and decoder.decode(own.astype(np.int64)) == library["byte_bpe_50k.json"].decode(want, skip_special_tokens=False)


def test_text_encoder_equals_library(library):
    encoder, texts = TextEncoder(tokenizer_file("word_bpe_49k.json"), known=500), fuzz()
    for _ in range(2):
        for text, own in zip(texts, encoder.encode(pa.array(texts))):
            assert list(own) == library["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


def thue_morse(n):
    """A word of n letters a and b, and its complement: equal under any polynomial hash modulo 2 ** 64 from 1,024 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


CRAFTED = [thue_morse(n) for n in (64, 512, 1024, 2048, 4096)]


def test_words_of_equal_hashes_have_their_own_ids(library, monkeypatch):
    texts = [x for pair in CRAFTED for x in pair] + [f"so {a} and {b}, {a} é{b}" for a, b in CRAFTED]
    want = [x.ids for x in library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    for known in (400_000, 3):
        made = TextEncoder(tokenizer_file("word_bpe_49k.json"), known)
        for _ in range(2):  # the second time from what it keeps
            assert [x.tolist() for x in made.encode(pa.array(texts))] == want
            assert [made.encode(pa.array([t]))[0].tolist() for t in texts] == want
    # However bad the hash is: all words of equal length meet.
    monkeypatch.setattr(TextEncoder, "_reach", lambda self, n: self.__dict__.update(powers=np.zeros(n, np.uint64), inverses=np.zeros(n, np.uint64)))
    texts += fuzz()
    want = [x.ids for x in library["word_bpe_49k.json"].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    made = TextEncoder(tokenizer_file("word_bpe_49k.json"))
    for _ in range(2):
        assert [x.tolist() for x in made.encode(pa.array(texts))] == want


def test_texts_of_equal_hashes_in_operators(spark, library):
    rows = [(2 * k + i, f"{word} x") for k, pair in enumerate(CRAFTED) for i, word in enumerate(pair)]
    ids = {i: library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids for i, t in rows}
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in ngram_join.ngram_join(docs(spark, rows)).collect())
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    found = token_store.round_trip(docs(spark, rows), tokenizer_file("word_bpe_49k.json")).collect()
    assert {r["doc_id"]: crc(np.frombuffer(r["ids"], "<u4")) for r in found} == {i: crc([*x, 2]) for i, x in ids.items()}
    pieces = packing.pack_documents(docs(spark, rows), tokenizer_file("word_bpe_49k.json")).where("piece = 0").collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in pieces} == {i: crc([*x, 0][:2048]) for i, x in ids.items()}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert stage(spark, docs(spark, rows), DATA).count() == len(rows)


def test_bpe_edges(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(docs(spark, EDGES), path), path).collect()
    assert sorted(repr(r["text"]) for r in both) == sorted(repr(t or "") for _, t in EDGES)
    assert bpe.encode(docs(spark, []), path).count() == 0


def best_bins(sizes, capacity):
    """The least number of bins, by trying all partitions of a few items."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_packing_plan_is_valid_and_near_best():
    random.seed(4)
    worse = 0
    for _ in range(60):
        sizes = sorted((random.randint(1, 20) for _ in range(random.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        rules, bins = packing.plan(counts, 20)
        fill: dict[int, list] = {}
        for size, rank, n, first, offset in rules.tolist():
            for k in range(n):
                fill.setdefault(first + k, []).append((offset, size))
        assert sum(len(x) for x in fill.values()) == len(sizes) and len(fill) == bins
        for parts in fill.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= 20
        worse += bins - best_bins(sizes, 20)
    assert worse <= 2


def test_packing_of_documents(spark, library):
    rows = [(i, f"word{i} " * (i % 7)) for i in range(80)] + EDGES
    got = packing.pack_documents(docs(spark, rows), tokenizer_file("word_bpe_49k.json"), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4"))) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    fill: dict[int, list] = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(sets)
    for (a, (i, x)), (b, (j, y)) in combinations(enumerate(sets), 2):
        if None not in (i, j) and x and y and den * len(x & y) >= num * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = sorted((top(i), top(j)))
            up[q] = p
    return sorted(repr((i, len(s), None if i is None else top(i), k)) for (i, s), k in zip(sets, links))


@pytest.mark.parametrize("join", [Join(), Join(n=5, num=80, den=100), Join(n=2, num=60, den=100, block=3, class_block=4, broadcast_rows=0)])
def test_ngram_join(spark, join):
    random.seed(5)
    base = [[random.choice("abcdefghijklmnop") * 2 for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(70):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 4, 9])):
            words[random.randrange(60)] = random.choice("qrstuv")
        rows.append((i * 3 % 71, " ".join(words)))
    rows += [(i and i + 1000, t) for i, t in EDGES]
    got = ngram_join.ngram_join(docs(spark, rows), join=join).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_components(rows, join.n, join.num, join.den)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, monkeypatch, few):
    from tidemark.llm import graph

    monkeypatch.setattr(graph, "FEW", few)
    random.seed(15)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    sets = graph.Sets()
    for a, b in edges:
        sets.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).distinct().collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, sets.top(x)) for x in nodes)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gram_sets_of_slices():
    """Slices of a batch have the sets of their own texts, upper case, nulls and code points of several bytes included."""
    texts = pa.array(["Été {} Über A B c".format(i) * (i % 3 + 1) for i in range(200)] + [None, "", "x Y z x Y z"], pa.string())
    want = [ngram_join.gram_sets(pa.array([x], pa.string()), 3)[0].tolist() for x in texts.to_pylist()]
    for first, count in ((0, 203), (1, 20), (8, 20), (64, 20), (150, 53), (202, 1)):
        assert [x.tolist() for x in ngram_join.gram_sets(texts.slice(first, count), 3)] == want[first : first + count]


def test_ngram_join_in_steps(spark):
    """Batches cut into steps give the result of SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.sql(SQL["op4_ngram_jaccard_join"]).fetchall()
    batch = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).combine_chunks().to_batches()[0]
    sizes = {i: len(x) for part in ngram_join.steps(batch, most=20_000) for i, x in zip(part["doc_id"].to_pylist(), ngram_join.gram_sets(part["text"], 3))}
    assert sizes == {r[0]: r[1] for r in want}
    assert sorted(map(tuple, QUERIES["op4_ngram_jaccard_join"](spark, DATA).collect())) == sorted(want)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_quality_classifier(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_classifier.fit(table, labels.where("doc_id % 3 <> 0"))
    got = quality_classifier.score(table, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert quality_classifier.score(docs(spark, EDGES), model).count() == len(EDGES)
    none = quality_classifier.fit(docs(spark, EDGES), labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs(spark, EDGES), none).collect()} == {0.5}
    assert quality_classifier.score(docs(spark, []), quality_classifier.fit(docs(spark, []), labels)).count() == 0


def test_language_id(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit_text_model(table.where("doc_id % 2 = 0"))
    held = language_id.identify(table.where("doc_id % 2 = 1"), model, ["doc_id", "lang"], text_col="text").toPandas()
    assert (held.detected == held.lang).mean() > 0.98
    edges = language_id.identify(docs(spark, EDGES), model, ["doc_id", "text", "c"], text_col="text", declared_col="lang", host_col="source").collect()
    by_text = {r["text"]: r["detected"] for r in edges}
    assert by_text[None] is None and by_text[""] is None and len(edges) == len(EDGES)
    page = '<html LANG=fr><script>var a="<p>";</script><p>x</p>'
    assert language_id.page_text(page).split() == ["x"] and language_id.address("https://a.b.fr:80/de/x?y")[:3] == ("a.b.fr", "b.fr", "fr/de")
    assert language_id.identify(docs(spark, []), model, ["doc_id"], text_col="text").count() == 0


def test_warc(spark, monkeypatch):
    assert warc.url_key("HTTPS://www.A.example.com:443/p?b=1&a=2#f") == "com,example,a)/p?a=2&b=1"
    random.seed(6)
    runs = [sorted(random.randrange(99) for _ in range(random.randrange(9))) for _ in range(7)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))
    assert list(warc.LoserTree([], lambda x: x)) == []
    same = "<p>" + "x" * 200
    rows = [(i, f"http://h{i % 3}.example.com/{i}", same if i % 2 else f"<p>{i}") for i in range(40)] + [(50, None, None), (51, "u\r\nv", "é" * 70), (None, "n", same)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string").repartition(9)
    monkeypatch.setattr(warc, "FAN_IN", 3)  # 11 runs or more: two passes before the last
    monkeypatch.setattr(warc, "ROLL_RECORDS", 4)
    monkeypatch.setattr(warc, "PER_RANGE", 9)
    folder = scratch_path(spark, "test-archive")
    index = warc.write_archive(pages, folder)
    keys = [(r["url_key"], r["timestamp"]) for r in index.collect()]
    assert len(keys) == len(rows)
    files = sorted(glob.glob(folder.removeprefix("file://") + "/index/part-*"))
    assert len([f for f in files if pq.read_metadata(f).num_rows]) > 2 and len(glob.glob(folder.removeprefix("file://") + "/runs/*-*/*.run")) > 4
    order = [(r["url_key"], r["timestamp"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert order == sorted(keys)
    got = {r["page_id"]: r for r in warc.read_archive(index, folder).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        again = i is not None and html == same and i != 1
        assert got[i]["payload_bytes"] == len(raw) and (i is None or got[i]["record_type"] == ("revisit" if again else "response"))
        assert got[i]["refers_to"] == (1 if again else None) or i is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_store(spark, library):
    rows = [(i + 100, f"the same long passage of words {'again and ' * 40} {i % 5}") for i in range(40)] + EDGES
    folder, vocabulary = scratch_path(spark, "test-store"), tokenizer_file("word_bpe_49k.json")
    manifest = token_store.write_store(docs(spark, rows), folder, vocabulary)
    got = token_store.read_store(spark, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in want] and manifest["documents"] == len(rows)
    at = 0
    for r, (_, t) in zip(got, want):
        ids = library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids + [2]
        assert r["start"] == at and r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert len({token_store.merkle([bytes([k]) for k in range(n)]) for n in range(1, 9)}) == 8
    ids = np.random.default_rng(8).integers(0, 49_000, 20_000).astype(np.uint32)
    moved = {x - 3 for x in token_store.cuts(np.concatenate([ids[-3:], ids]))}
    assert len(set(token_store.cuts(ids)) & moved) > 0.8 * len(moved)  # cuts follow the content
    path = glob.glob(folder.removeprefix("file://") + "/packs/*")[0]
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_store.read_store(spark, folder).collect()
    assert token_store.round_trip(docs(spark, []), vocabulary).count() == 0


def test_ann(spark):
    random.seed(7)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(3000)]
    rows += [(5000, None, ""), (5050, [], ""), (5100, [0.0] * 16, ""), (5150, [float("nan")] + [1.0] * 15, ""), (5200, [None] + [1.0] * 15, ""), (5250, [1.0] * 3, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string")
    got = ann.search(df, "vec_id % 50 = 0", settings=ann.Settings(block=1000, sample=1000, rerank=128)).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q, g in got.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hit += len(set(best) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and np.allclose(score[g.vec_id], g.score)
    assert got.query_id.nunique() == 60 and hit / (5 * 60) >= 0.9
    assert list(got[got.query_id == 150].sort_values("rank").vec_id) == [100, 101, 102, 103, 104]
    assert ann.search(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_ann_of_very_small_and_large_components(spark):
    x = np.random.default_rng(9).normal(size=(60, 8))
    rows = [(i, [float(v) * (1e-200, 1.0, 1e200)[i % 3] for v in x[i]]) for i in range(60)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id % 50 = 0").collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 50):
        score = unit @ unit[q]
        score[q] = -2
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-score)[:5].tolist()


def test_ann_recall_at_default_settings():
    """On 50,000 vectors in one block, a hundred times what is reranked."""
    settings, rng = ann.Settings(), np.random.default_rng(10)
    x = rng.normal(size=(50_000, 32)) + 2 * rng.normal(size=(500, 32))[rng.integers(0, 500, 50_000)]
    unit = ann._unit(x)
    books = ann.fit_codebooks(unit[: settings.sample], settings)
    codes, norms = (np.concatenate(c) for c in zip(*(books.encode(unit[i : i + 1024].astype(np.float32), settings.beam) for i in range(0, len(x), 1024))))
    hit = 0
    for q in range(0, 5000, 100):
        table = np.einsum("d,bwd->bw", unit[q].astype(np.float32), books.words)
        near = sum(table[b][codes[:, b]] for b in range(settings.books)) / norms
        near[q] = -2
        score = unit @ unit[q]
        score[q] = -2
        hit += len(set(np.argsort(-score)[:5]) & set(np.argsort(-near)[: settings.rerank]))
    assert hit / 250 >= 0.9


def test_page_text_scans_once():
    import time

    cases = {
        "a<!-- x -->b<p>c": "a b c", "<script>1</script >z": "z", "<script>no end <b>x": "no end x", "<!-- no end > x": "x", "1 < 2": "1 < 2",
        "<STYLE a='>'>p{}</style>q<!doctype html>": "q", "<scripted>y</scripted>": "y", "": "", "<": "<",
    }
    for page, want in cases.items():
        assert language_id.page_text(page).split() == want.split(), page
    began = time.time()
    for page in ("<!-- " * 400_000, "<script " * 250_000, "<" * 1_000_000, "<html " * 300_000):
        language_id.page_text(page)
        language_id._DECLARED.search(page)
    assert time.time() - began < 20


def test_language_fusion_equals_plain_python(spark):
    """All four kinds of evidence on pages, against the same sums in plain Python."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model, settings = language_id.fit_text_model(table), language_id.Settings()
    texts = [r["text"] for r in table.where("length(text) > 300 AND lang IS NOT NULL").orderBy("doc_id").limit(40).collect()]
    random.seed(13)
    rows = []
    for i, t in enumerate([*texts, "", "x", None]):
        html = None if t is None else f"<html lang={random.choice(['en', 'fr', 'xx'])}><p>{t}</p>" if i % 3 else f"<p>{t}"
        rows.append((i, random.choice(["http://a.x.fr/en/1", "http://b.x.fr/2", "http://c.y.de/3", None, "http://b.x.fr/es/"]), html))
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model, ["page_id"], html_col="html", url_col="url").collect()
    width, seen = len(model.languages), []
    for i, url, html in rows:
        found = language_id._DECLARED.search(html or "")
        grams = language_id.trigram_buckets(language_id.page_text(html or ""))
        score, other = np.zeros(width), -np.inf
        if len(grams):
            share = min(1.0, settings.tempered / len(grams))
            score = model.log_p[grams].sum(axis=0, dtype=float) * share
            other = -np.log(language_id.BUCKETS) * len(grams) * share - score.max()
            score -= score.max()
        enough = len(grams) >= settings.least_letters
        seen.append((i, found and found[1].lower(), *language_id.address(url), int(score.argmax()) if enough and other <= 0 else None, enough and other > 0, score))
    counts = lambda rows: np.array([sum(r[5] == k for r in rows) for k in range(width)], float)
    total = counts(seen)
    base = (total + 1) / (total.sum() + width)
    want = {}
    for r in seen:
        own = np.array([r[5] == k for k in range(width)], float)
        score, evidence = r[7].copy(), r[5] is not None
        same = [x for x in seen if x[2] == r[2] and x[5] is not None and r[2] is not None]
        prior = base
        if same:
            evidence = True
            domain = counts([x for x in seen if x[3] == r[3]])
            domain = (domain + settings.domain_weight * base) / (domain.sum() + settings.domain_weight)
            host = counts(same) - own
            prior = (host + settings.host_weight * domain) / (host.sum() + settings.host_weight)
        score = score + np.log(prior)
        for at in (1, 4):
            alike = [x for x in seen if x[at] == r[at] and x[5] is not None and r[at] is not None]
            if alike:
                evidence, c = True, counts(alike)
                score = score + np.log((c + settings.table_weight * c.sum() / max(1, total.sum())) / (total + settings.table_weight))
        p = np.exp(score - score.max())
        want[r[0]] = (model.languages[int(score.argmax())], p.max() / p.sum()) if evidence and not r[6] else (None, 0.0)
    assert len(got) == len(rows)
    for r in got:
        assert r["detected"] == want[r["page_id"]][0] and abs(r["confidence"] - want[r["page_id"]][1]) < 1e-9, (r, want[r["page_id"]])


def test_co_training_rounds():
    """Each view gets, once each, the rows that the other is surest of; without a pool it is plain logistic regression."""
    rng = np.random.default_rng(14)
    y = rng.integers(0, 2, 600).astype(float)
    text, meta = y[:, None] * 2 + rng.normal(size=(600, 3)), y[:, None] * 2 + rng.normal(size=(600, 2))
    held = np.arange(600) % 4 == 0
    pool_y = rng.integers(0, 2, 2000).astype(float)
    more = pool_y[:, None] * 2 + rng.normal(size=(2000, 3)), pool_y[:, None] * 2 + rng.normal(size=(2000, 2))
    settings = quality_classifier.Settings(rounds=2, per_round=50)
    views, pool, label = [text[~held], meta[~held]], list(more), y[~held]
    ties = np.random.default_rng(11).permutation(2000)
    given = [{}, {}]

    def fit(v):
        x, t = list(views[v]), list(label)
        w = [1.0] * len(t)
        for i, kind in given[v].items():
            x.append(pool[v][i])
            t.append(kind)
            w.append(0.5)
        x, t, w = np.array(x), np.array(t, float), np.array(w)
        share = (w * t).sum() / w.sum()
        return quality_classifier.fit_logistic(x, t, w * np.where(t == 1, 0.5 / share, 0.5 / (1 - share)), penalty=settings.penalty * max(1.0, 1000 / len(t)))

    weights = [fit(0), fit(1)]
    for _ in range(2):
        for v in (0, 1):
            p = 1 / (1 + np.exp(-(pool[v] @ weights[v][:-1] + weights[v][-1])))
            for kind in (1, 0):
                sure = p if kind else 1 - p
                free = sorted((i for i in range(2000) if i not in given[1 - v] and sure[i] >= settings.sure), key=lambda i: (-sure[i], ties[i]))
                given[1 - v].update(dict.fromkeys(free[:50], kind))
        weights = [fit(0), fit(1)]
    model = quality_classifier.co_train(text, meta, y, held, *more, settings)
    assert np.allclose(model.text, weights[0]) and np.allclose(model.meta, weights[1])
    assert len(given[0]) > 100 and ((model.scores(more[0], more[1])[0] > 0.5) == pool_y).mean() > 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = cp.keep_good(spark, table, DATA)
    assert rows.columns == table.columns
    clean = table.join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1"), "doc_id", "left_semi")
    verdicts = quality_rules(table).select("doc_id", "base_failed")
    lost = clean.join(rows.select("doc_id"), "doc_id", "left_anti").join(verdicts, "doc_id").where("NOT base_failed")
    assert lost.count() == 0
    rows = cp.keep_identified(spark, rows, DATA)
    assert rows.columns == table.columns
    cleaned = cp.drop_repeated_lines(spark, rows, DATA)
    want = brute_lines([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()])
    left = {i: t for (i, _), t in want.items() if t is not None and re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == left
    few = [(i, t) for i, t in left.items()]
    kept = {r["doc_id"] for r in cp.drop_near_duplicates(spark, cleaned, DATA).collect()}
    found = [eval(x) for x in brute_components(few, 5, 80, 100)]
    assert kept == {i for i, _, component, _ in found if i == component}
    assert cp.pack_sequences(spark, cleaned, DATA).count() >= cleaned.count()


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    import corpus_pipeline as cp

    random.seed(12)
    text = lambda: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, other = text(), text(), text(), text()
    rows = [(1, a), (1, a), (2, a + " more"), (None, b), (None, b), (7, c), (None, c), (9, None), (9, ""), (4, a), (4, other), (4, other)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = [tuple(r) for r in cp.drop_near_duplicates(spark, table, DATA).select("doc_id", "text").collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, a), (None, b), (7, c), (4, other), (9, None), (9, "")]))


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_pipeline_stage_edges(spark, stage):
    """No stage fails on nulls, repeated rows, long texts and empty tables; all but the last keep the columns."""
    import corpus_pipeline as cp

    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    rows = [(i, t, None if i is None else "en", None, None) for i, t in EDGES] + [(8, "x y z " * 30, None, "s", 1), (None, None, None, None, None)]
    for some in (rows, []):
        got = cp.STAGES[stage][1](spark, spark.createDataFrame(some, schema), DATA)
        assert got.count() <= 2 * len(some) + 20 and (stage == 4 or got.columns == ["doc_id", "text", "lang", "source", "n_chars"])


CLASHES = ["n_lines", "N_removed", "kept", "base_failed", "n_words", "detected", "confidence", "text_confidence", "declared", "row", "lines", "_id", "_0", "_text", "component_id", "base", "q"]


def clashing(spark):
    """Whole good documents, with a column of each name that an operator gives or uses, each with its own value."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 1500").limit(40)
    return table.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in CLASHES))


def unharmed(rows):
    assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in CLASHES)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_pipeline_stages_keep_columns_of_any_name(spark, stage):
    table = clashing(spark)
    got = corpus_pipeline.STAGES[stage][1](spark, table, DATA)
    assert got.columns == table.columns
    unharmed(got.collect())
    plain = corpus_pipeline.STAGES[stage][1](spark, table.select("doc_id", "text", "lang", "source", "n_chars"), DATA)
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:5] for r in got.collect())


def test_operators_keep_columns_of_any_name(spark):
    table = clashing(spark)
    found = line_dedup(table)
    unharmed(found.collect())
    assert found.columns[-2:] == ["n_lines_", "n_removed_"] and found.where("n_lines_ >= n_removed_").count() == 40
    found = quality_rules(table)
    unharmed(found.collect())
    assert found.where("kept_ AND NOT base_failed_ AND n_words_ >= 50").count() > 10
    model = language_id.fit_text_model(table)
    for some in (model, language_id.fit_text_model(table.limit(0))):
        found = language_id.identify(table, some, table.columns, text_col="text", declared_col="lang", host_col="source")
        unharmed(found.collect())
        assert found.columns[-5:] == ["detected_", "confidence_", "text_detected", "text_confidence_", "declared_"]


def test_language_unknown_or_contradicted(spark):
    """Planted gibberish, foreign and mislabelled texts go; texts that agree with their labels stay."""
    import corpus_pipeline as cp

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    good = table.where("length(text) BETWEEN 1000 AND 3000").orderBy("doc_id").limit(40).collect()
    random.seed(11)
    noise = lambda letters: " ".join("".join(random.choices(letters, k=random.randint(2, 9))) for _ in range(120))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 4
    planted = [noise("bcdfghjklmnpqrstvwxz"), noise("абвгдежзийклмнопрст"), noise([chr(c) for c in range(0x4E00, 0x5E00)]), finnish]
    rows = [(900_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(planted)]
    rows += [(910_000 + i, r["text"], next(x for x in ("en", "fr") if x != r["lang"]), r["source"], r["n_chars"]) for i, r in enumerate(good[:5])]
    more = spark.createDataFrame(rows, table.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = table.select(*more.columns).unionByName(more)
    kept = {r["doc_id"] for r in cp.keep_identified(spark, both, DATA).collect()}
    assert not kept & {r[0] for r in rows} and {r["doc_id"] for r in good} <= kept
    model = language_id.fit_text_model(table)
    found = language_id.identify(more.where("doc_id < 910000"), model, ["doc_id"], text_col="text", declared_col="lang", host_col="source").collect()
    assert {(r["detected"], r["confidence"], r["text_detected"]) for r in found} == {(None, 0.0, None)}


def test_pipeline_judges_short_texts(spark):
    """Junk of 50 to 99 words goes; documents of that length labelled good stay."""
    import corpus_pipeline as cp

    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    random.seed(5)
    junk = [" ".join("".join(random.choices("rmiuecodl", k=4)) + random.choice(["$$$", "%%%", "&&&"]) for _ in range(n)) for n in (50, 60, 99)]
    rows = [(900_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(junk)]
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] in good}
    short = {i for i, t in texts.items() if t and 50 <= len(t.split()) < 100 and len(set(t.split())) > 0.7 * len(t.split())}
    kept = {r["doc_id"] for r in cp.keep_good(spark, table.unionByName(spark.createDataFrame(rows, table.schema)), DATA).select("doc_id").collect()}
    assert not kept & {r[0] for r in rows}
    assert short and short <= kept
