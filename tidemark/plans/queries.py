"""The queries of the engine's own operators and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..base import written
from ..functions import json as J
from ..functions import text as T
from ..functions import vectors as V
from ..operators import evidence as E
from ..operators import freshness as R
from ..operators import matching as M
from ..operators import projection as P
from ..operators import provenance as O
from ..operators import stats as S
from ..operators.similarity import pair_extremes, similarity_topk
from ..sources import connectors as C
from ..sources import retrievers
from ..sources import store as U
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(x: str) -> str:
    """Matching tokens in DuckDB's SQL."""
    found = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains([{_STOP}], t))"
    return f"list_transform({found}, lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END)"


_BUCKET = "CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 256 AS INTEGER)"
_HASH = "substr(sha256({}), 1, 16)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TURNS = """turns AS (SELECT conv_id * 1000 + turn AS qid, conv_id, turn, text AS query,
    CASE conv_id % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' END AS namespace
    FROM conversations WHERE role = 'user')"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Text and vectors -------------------------------------------------------------------------------


@query("tokenize_documents", f"""
SELECT doc_id, array_to_string(x, ' ') AS tokens, CAST(len(x) AS INTEGER) AS n FROM (SELECT doc_id, {_tok('text')} AS x FROM documents)""")
def tokenize_documents(spark, d):
    x = T.tokens(F.col("text"))
    return B.table(spark, d, "documents").select("doc_id", F.array_join(x, " ").alias("tokens"), F.size(x).alias("n"))


_TF = f"""tf AS (SELECT doc_id, {_BUCKET} AS bucket, count(*) AS tf FROM
    (SELECT doc_id, unnest({_tok('text')}) AS t FROM documents) GROUP BY ALL)"""


@query("token_freq_buckets", f"WITH {_TF} SELECT doc_id, bucket, tf FROM tf")
def token_freq_buckets(spark, d):
    return V.bucket_table(B.table(spark, d, "documents"), ["doc_id"], "text")


@query("hash_embedding_norms", f"""
WITH {_TF} SELECT doc_id, CAST(sum(tf * tf) AS BIGINT) AS squared, round(sqrt(sum(tf * tf)), 6) AS norm FROM tf GROUP BY doc_id""")
def hash_embedding_norms(spark, d):
    tf = V.bucket_table(B.table(spark, d, "documents"), ["doc_id"], "text")
    squared = F.sum(F.col("tf") * F.col("tf"))
    return tf.groupBy("doc_id").agg(squared.alias("squared"), F.round(F.sqrt(squared), 6).alias("norm"))


def _retrieved(spark, d, k: int, namespaces: str) -> DataFrame:
    turns = B.spread(B.turns(spark, d)).select("qid", F.col("namespace").alias("ns"), V.buckets(F.col("query")).alias("vector"))
    docs = B.spread(B.corpus(spark, d)).select("seq", F.col("namespace").alias("ns"), V.buckets(F.col("text")).alias("vector"))
    best = similarity_topk(turns, docs, k, namespaces=namespaces, decimals=None, dim=V.DIM)
    return best.select("qid", F.col("seq").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _retrieved_sql(k: int, visible: bool) -> str:
    seen = "WHERE p.namespace IS NULL OR x.lang IS NULL OR p.namespace = x.lang" if visible else ""
    return f"""
WITH {_TURNS}, {_TF},
qtf AS (SELECT qid, {_BUCKET} AS bucket, count(*) AS tf FROM (SELECT qid, unnest({_tok('query')}) AS t FROM turns) GROUP BY ALL),
dn AS (SELECT doc_id, sum(tf * tf) AS n FROM tf GROUP BY doc_id), qn AS (SELECT qid, sum(tf * tf) AS n FROM qtf GROUP BY qid),
dots AS (SELECT qid, doc_id, sum(q.tf * f.tf) AS dot FROM qtf q JOIN tf f USING (bucket) GROUP BY ALL),
scored AS (SELECT d.qid, d.doc_id, d.dot / (sqrt(qn.n) * sqrt(dn.n)) AS score FROM dots d JOIN qn USING (qid) JOIN dn USING (doc_id)
    JOIN turns p ON p.qid = d.qid JOIN documents x ON x.doc_id = d.doc_id {seen}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT qid, doc_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE r <= {k}"""


@query("retrieve_topk", _retrieved_sql(5, False))
def retrieve_topk(spark, d):
    return _retrieved(spark, d, 5, "none")


@query("retrieve_topk_namespace", _retrieved_sql(5, True))
def retrieve_topk_namespace(spark, d):
    return _retrieved(spark, d, 5, "visible")


@query("retrieve_best", _retrieved_sql(1, False))
def retrieve_best(spark, d):
    return _retrieved(spark, d, 1, "none")


@query("lexical_overlap_topk", f"""
WITH {_TURNS}, a AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM turns),
b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
s AS (SELECT qid, doc_id, count(*) AS score FROM a JOIN b USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS k FROM s)
SELECT qid, doc_id, CAST(k AS INTEGER) AS rank, score FROM r WHERE k <= 4""")
def lexical_overlap_topk(spark, d):
    best = retrievers.lexical_topk(B.spread(B.turns(spark, d)), B.spread(B.corpus(spark, d)), 4)
    return best.select("qid", F.col("seq").alias("doc_id"), "rank", "score")


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product(CAST({x} AS DOUBLE[]), CAST({y} AS DOUBLE[]))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


@query("dense_cosine_topk", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round({_cos('a.embedding', 'b.embedding')}, 9) AS score
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s WHERE score > 0)
SELECT qid, vec_id, CAST(k AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE k <= 5""")
def dense_cosine_topk(spark, d):
    v = B.vectors(spark, d)
    best = similarity_topk(v.withColumnRenamed("seq", "qid"), v, 5, not_itself=True)
    return best.select("qid", F.col("seq").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


# Matching ---------------------------------------------------------------------------------------


def _units(spark, d) -> DataFrame:
    """Each vector as a unit whose seed is the next vector; every seventh has no understanding yet."""
    v = B.vectors(spark, d)
    seed = v.select((F.col("seq") - 1).alias("seq"), F.col("vector").alias("seed"))
    known = F.when(F.pmod("seq", F.lit(7)) == 0, F.array().cast("array<double>")).otherwise(F.col("vector"))
    return v.join(seed, "seq").select(F.col("seq").alias("unit_seq"), "ns", "seed", known.alias("understanding"))


def _reads(spark, d) -> DataFrame:
    return B.vectors(spark, d).select(F.col("seq").alias("qid"), "ns", F.col("vector").alias("q"))


_UNITS = """units AS (SELECT u.vec_id AS unit_seq, u.label AS ns, s.embedding AS seed, u.embedding AS understanding, u.vec_id % 7 = 0 AS bare
    FROM embeddings u JOIN embeddings s ON s.vec_id = u.vec_id + 1)"""
_BLEND = f"CASE WHEN bare THEN {_cos('e.embedding', 'seed')} ELSE 0.7 * {_cos('e.embedding', 'understanding')} + 0.3 * {_cos('e.embedding', 'seed')} END"
_BEST = f"""best AS (SELECT e.vec_id AS qid, unit_seq, round({_BLEND}, 9) AS score FROM embeddings e JOIN units u ON u.ns = e.label),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_seq) AS r FROM best) WHERE r = 1)"""


def _matched(spark, d) -> DataFrame:
    return M.best_match_by_product(_reads(spark, d), _units(spark, d))


@query("best_match_blended", f"WITH {_UNITS}, {_BEST} SELECT e.vec_id AS qid, unit_seq, round(coalesce(score, -1), 6) AS score FROM embeddings e LEFT JOIN top ON qid = vec_id")
def best_match_blended(spark, d):
    return _matched(spark, d).select("qid", "unit_seq", F.round("score", 6).alias("score"))


@query("best_match_seed_fallback", f"""
WITH {_UNITS}, b AS (SELECT e.vec_id AS qid, unit_seq, round({_cos('e.embedding', 'seed')}, 9) AS score FROM embeddings e JOIN units u ON u.ns = e.label),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_seq) AS r FROM b) WHERE r = 1)
SELECT e.vec_id AS qid, unit_seq, round(coalesce(score, -1), 6) AS score FROM embeddings e LEFT JOIN top ON qid = vec_id""")
def best_match_seed_fallback(spark, d):
    bare = _units(spark, d).withColumn("understanding", F.array().cast("array<double>"))
    return M.best_match_by_product(_reads(spark, d), bare).select("qid", "unit_seq", F.round("score", 6).alias("score"))


_CLAIM_MAX = f"""per AS (SELECT e.vec_id AS qid, c.label, max({_cos('e.embedding', 'c.embedding')}) AS top FROM embeddings e JOIN embeddings c
    ON e.label <> c.label GROUP BY ALL)"""


def _claim_scores(spark, d) -> DataFrame:
    """The best claim of each other label for each read: the similarity join with one row a label."""
    v = B.vectors(spark, d)
    best = similarity_topk(v.withColumnRenamed("seq", "qid"), v, 1, positive=False, groups=True, decimals=None)  # rounded once, where they are ranked or given
    own = v.select(F.col("seq").alias("qid"), F.col("label").alias("own"))
    return best.join(own, "qid").join(v.select("seq", "label"), "seq").where("own <> label").select("qid", "label", F.col("score").alias("top"))


@query("route_by_claim", f"""
WITH {_CLAIM_MAX} SELECT qid, label, round(top, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(top, 9) DESC, label) AS r FROM per) WHERE r = 1""")
def route_by_claim(spark, d):
    first = Window.partitionBy("qid").orderBy(F.desc(F.round("top", 9)), "label")
    return _claim_scores(spark, d).withColumn("r", F.row_number().over(first)).where("r = 1").select("qid", "label", F.round("top", 6).alias("score"))


_STATUS = "CASE WHEN unit_seq % 3 = 0 THEN 'dirty' ELSE 'fresh' END"


@query("hit_classification", f"""
WITH {_UNITS}, {_BEST} SELECT vec_id AS qid, CASE WHEN coalesce(score, -1) < 0.6 THEN 'miss' WHEN {_STATUS} <> 'fresh' OR unit_seq % 5 = 0
THEN 'hit_stale' ELSE 'hit_fresh' END AS outcome FROM embeddings LEFT JOIN top ON qid = vec_id""")
def hit_classification(spark, d):
    status = F.when(F.col("unit_seq") % 3 == 0, "dirty").otherwise("fresh")
    outcome = M.classify(F.col("score"), 0.6, status, F.col("unit_seq") % 5 == 0)
    return _matched(spark, d).select("qid", outcome.alias("outcome"))


_COVERED = f"""WITH c AS (SELECT e.vec_id AS qid, max({_cos('e.embedding', 'c.embedding')}) AS coverage FROM embeddings e
    LEFT JOIN embeddings c ON c.vec_id IN (e.vec_id + 1, e.vec_id + 2, e.vec_id + 3) GROUP BY e.vec_id),
    covered AS (SELECT qid, coalesce(coverage, 1.0) AS coverage FROM c)"""


def _covered(spark, d) -> DataFrame:
    """Each vector as a read of a unit whose claims are the three vectors after it, as far as there are."""
    v = B.vectors(spark, d)
    near = v.select(F.explode(F.array(*(F.col("seq") - k for k in (1, 2, 3)))).alias("qid"), F.col("vector").alias("claim"))
    claims = near.groupBy("qid").agg(F.collect_list("claim").alias("claims"))
    both = v.select(F.col("seq").alias("qid"), F.col("vector").alias("q")).join(claims, "qid", "left")
    return both.select("qid", M.coverage(F.col("q"), F.col("claims")).alias("coverage"))


@query("coverage_by_claim", _COVERED + " SELECT qid, round(coverage, 6) AS coverage FROM covered")
def coverage_by_claim(spark, d):
    return _covered(spark, d).select("qid", F.round("coverage", 6).alias("coverage"))


@query("coverage_gate", _COVERED + """ SELECT qid, (qid % 4 <> 0 AND round(coverage, 9) < 0.2 AND qid % 3 = 0 AND qid % 11 <> 0) AS escalated FROM covered""")
def coverage_gate(spark, d):
    n = F.col("qid") % 3
    strategy = F.when(n == 0, "context_first").when(n == 1, "context_raw").otherwise("context_only")
    gate = M.escalates(F.col("qid") % 4 != 0, F.round("coverage", 9), 0.2, strategy, F.col("qid") % 11 == 0)
    return _covered(spark, d).select("qid", gate.alias("escalated"))


@query("two_tier_scorer", _COVERED + """ SELECT qid, round(CASE WHEN round(coverage, 9) >= 0.1 AND round(coverage, 9) < 0.4
THEN coverage * coverage ELSE coverage END, 6) AS coverage FROM covered""")
def two_tier_scorer(spark, d):
    rows = _covered(spark, d).withColumn("coverage", F.round("coverage", 9))
    scored = M.two_tier(rows, lambda df: df.withColumn("coverage", F.col("coverage") * F.col("coverage")), 0.1, 0.4)
    return scored.select("qid", F.round("coverage", 6).alias("coverage"))


# Projection -------------------------------------------------------------------------------------

_LINES = "list_filter(string_split(text, chr(10)), lambda l: l <> '')"


@query("project_claims", f"""
WITH d AS (SELECT doc_id, {_LINES} AS claims, {_tok("split_part(text, chr(10), 1)")} AS q FROM documents),
k AS (SELECT doc_id, claims, list_filter(claims, lambda c: len(list_intersect({_tok('c')}, q)) > 0) AS kept FROM d)
SELECT doc_id, CAST(len(CASE WHEN len(kept) = 0 THEN claims ELSE kept END) AS INTEGER) AS n,
       md5(array_to_string(CASE WHEN len(kept) = 0 THEN claims ELSE kept END, '|')) AS body FROM k""")
def project_claims(spark, d):
    claims = F.filter(F.split("text", "\n"), lambda x: x != "")
    kept = P.project_claims(claims, F.split("text", "\n")[0])
    rows = B.table(spark, d, "documents").select("doc_id", kept.alias("k"))
    return rows.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", "|")).alias("body"))


@query("project_facts", f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'which language is ' || lang WHEN 1 THEN 'from ' || source ELSE 'nothing' END AS q,
    ['language', 'origin', 'length'] AS k, [lang, source, CAST(n_chars AS VARCHAR)] AS v FROM documents),
f AS (SELECT doc_id, {_tok('q')} AS q, unnest(k) AS k, unnest(v) AS v FROM d),
m AS (SELECT *, len(list_intersect({_tok("k || ' ' || v")}, q)) > 0 AS hit FROM f),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS hits FROM m)
SELECT doc_id, string_agg(k || '=' || v, ',' ORDER BY k) AS facts FROM n WHERE hit OR NOT hits GROUP BY doc_id""")
def project_facts(spark, d):
    facts = F.create_map(F.lit("language"), F.col("lang"), F.lit("origin"), F.col("source"), F.lit("length"), F.col("n_chars").cast("string"))
    n = F.col("doc_id") % 3
    asked = F.when(n == 0, F.concat(F.lit("which language is "), "lang")).when(n == 1, F.concat(F.lit("from "), "source")).otherwise("nothing")
    entries = F.array_sort(F.transform(F.map_entries(P.project_facts(facts, asked)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return B.table(spark, d, "documents").select("doc_id", F.array_join(entries, ",").alias("facts"))


@query("context_strategy", """
SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE conv_id % 2 = 0 END AS raw FROM conversations""")
def context_strategy(spark, d):
    n = F.col("turn") % 4
    strategy = F.when(n == 0, "context_first").when(n == 1, "context_raw").when(n == 2, "context_only").otherwise("unknown")
    return B.table(spark, d, "conversations").select("conv_id", "turn", M.emits_raw(strategy, F.col("conv_id") % 2 == 0).alias("raw"))


@query("context_projection", f"""
SELECT doc_id, split_part(text, chr(10), 1) AS summary, CASE doc_id % 2 WHEN 0 THEN md5(text) END AS raw FROM documents""")
def context_projection(spark, d):
    chunk = F.array(F.struct(F.col("source").alias("artifact_id"), F.col("text").alias("text")))
    even = F.col("doc_id") % 2 == 0
    none = F.create_map().cast("map<string,string>")
    c = P.context(F.split("text", "\n")[0], F.array().cast("array<string>"), none, chunk, F.lit("x"), F.lit("context_first"), even, F.lit(False))
    rows = B.table(spark, d, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.col("c.understanding.summary").alias("summary"), F.md5(F.get("c.raw", F.lit(0))["text"]).alias("raw"))


# Scalar functions -------------------------------------------------------------------------------


@query("content_hash", f"SELECT doc_id, {_HASH.format('text')} AS content_hash FROM documents")
def content_hash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("unit_id", f"WITH {_TURNS} SELECT qid, 'cog:' || substr(sha1(coalesce(namespace, '') || '|' || query), 1, 16) AS id FROM turns")
def unit_id(spark, d):
    return B.turns(spark, d).select("qid", T.unit_id(F.col("namespace"), F.col("query")).alias("id"))


_PART = "'part:' || l_partkey"
_PART_HASH = _HASH.format("'part ' || l_partkey")


@query("provenance_fingerprint", f"""
SELECT l_orderkey AS id, substr(sha256('synth@1semantic@2' || string_agg({_PART} || '@v1#*:' || {_PART_HASH}, '' ORDER BY {_PART}, l_linenumber)), 1, 16)
AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def provenance_fingerprint(spark, d):
    f = T.fingerprint(F.lit("synth@1"), F.lit("semantic@2"), F.col("source_spans"))
    return B.order_units(spark, d).select("id", f.alias("fingerprint"))


@query("span_identity", f"SELECT l_orderkey AS id, l_linenumber AS line, {_PART} || '@v1#*:' || {_PART_HASH} AS identity, {_PART} || '#*' AS key FROM lineitem")
def span_identity(spark, d):
    part = F.concat(F.lit("part:"), "l_partkey")
    span = F.struct(
        part.alias("artifact_id"), F.lit("v1").alias("version"), F.lit(None).cast("string").alias("span"),
        T.content_hash(F.concat(F.lit("part "), "l_partkey")).alias("content_hash"),
    )
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", span.alias("s"))
    s = F.col("s")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), T.span_identity(s).alias("identity"), T.span_key(s).alias("key"))


@query("digest_text", f"""
WITH d AS (SELECT doc_id, lang, source, n_chars, {_LINES} AS l FROM documents)
SELECT doc_id, md5(concat_ws(' ', l[1], nullif(array_to_string(l[2:], ' '), ''), lang, source, 'length ' || n_chars)) AS digest FROM d""")
def digest_text(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    facts = F.create_map(F.lit("length"), F.col("n_chars").cast("string"))
    digest = T.digest_text(F.get(lines, F.lit(0)), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), F.array("lang", "source"), facts)
    return B.table(spark, d, "documents").select("doc_id", F.md5(digest).alias("digest"))


@query("claim_texts", f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(c, '|')) AS body FROM (SELECT doc_id,
list_concat(list_filter(list_transform(l, lambda x: {_STRIP.format('x')}), lambda x: x <> ''), CASE WHEN {_STRIP.format('left(text, 20)')} <> '' THEN [left(text, 20)] ELSE [] END) AS c FROM d)""")
def claim_texts(spark, d):
    c = T.claim_texts(F.substring("text", 1, 20), F.split("text", "\n"))
    rows = B.table(spark, d, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("body"))


@query("text_display", r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS flat, text FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 50 THEN flat ELSE left(flat, 47) || '...' END AS preview,
CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_tokens,
md5('  ' || replace(regexp_replace(text, '\n$', ''), chr(10), chr(10) || '  ')) AS indented FROM d""")
def text_display(spark, d):
    t = F.col("text")
    n = F.when(t.isNotNull(), T.token_count(t, T.SQL_BLANK))
    return B.table(spark, d, "documents").select("doc_id", T.preview(t).alias("preview"), n.alias("n_tokens"), F.md5(T.indent(t)).alias("indented"))


@query("age_display", """
SELECT event_id, CASE WHEN s < 90 THEN CAST(floor(s) AS BIGINT) || 's' WHEN s < 5400 THEN CAST(floor(s / 60) AS BIGINT) || 'm'
WHEN s < 129600 THEN CAST(floor(s / 3600) AS BIGINT) || 'h' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd' END AS age
FROM (SELECT event_id, greatest(0.0, value * value) AS s FROM events)""")
def age_display(spark, d):
    return B.table(spark, d, "events").select("event_id", T.age(F.col("value") * F.col("value")).alias("age"))


@query("prompt_text", """
SELECT doc_id, md5('Sources, each with its number to cite in "used":' || chr(10) || '[S0] (' || source || ')' || chr(10) || text || chr(10) || '[S1] (' || lang
|| ')' || chr(10) || source || chr(10) || chr(10) || 'Question: ' || lang || chr(10) || chr(10) || 'Say it briefly.' || chr(10)
|| 'Answer with one JSON object that has the keys "summary", "claims", and "used": the integer numbers of the sources relied on.') AS prompt FROM documents""")
def prompt_text(spark, d):
    chunk = lambda a, t: F.struct(F.col(a).alias("artifact_id"), F.col(t).alias("text"))
    made = T.prompt(F.col("lang"), F.array(chunk("source", "text"), chunk("lang", "source")), "Say it briefly.", ["summary", "claims"])
    return B.table(spark, d, "documents").select("doc_id", F.md5(made).alias("prompt"))


@query("depth_tiers", """
SELECT event_id, CASE WHEN x <= 0.34 THEN 'terse' WHEN x >= 0.67 THEN 'exhaustive' ELSE 'balanced' END AS tier
FROM (SELECT event_id, least(1.0, greatest(0.0, value / 20)) AS x FROM events)""")
def depth_tiers(spark, d):
    return B.table(spark, d, "events").select("event_id", T.depth_tier(F.col("value") / 20).alias("tier"))


@query("default_thresholds", f"""
WITH s AS (SELECT a.vec_id AS id, max(round({_cos('a.embedding', 'b.embedding')}, 9)) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id),
k AS (SELECT * FROM (VALUES ('hashing', 0.6::DOUBLE, 0.5::DOUBLE), ('openai', 0.33, 0.28), ('other', 0.45, 0.4)) AS t(kind, hit_threshold, coverage_floor))
SELECT kind, hit_threshold, coverage_floor, CAST(count_if(score >= hit_threshold) AS BIGINT) AS hits, CAST(count_if(score >= coverage_floor AND score < hit_threshold) AS BIGINT) AS near
FROM k, s GROUP BY ALL""")
def default_thresholds(spark, d):
    """What each kind of embedder's thresholds make of the best scores among all vectors."""
    v = B.vectors(spark, d)
    best = similarity_topk(v.withColumnRenamed("seq", "qid"), v, 1, positive=False, not_itself=True)
    kinds = [(k, *M.default_thresholds(k)) for k in ("hashing", "openai", "other")]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(h).alias("hit_threshold"), F.lit(c).alias("coverage_floor")) for k, h, c in kinds)))
    rows = best.select("score", each.alias("k")).select("score", "k.*")
    hit, near = F.col("score") >= F.col("hit_threshold"), F.col("score") >= F.col("coverage_floor")
    return rows.groupBy("kind", "hit_threshold", "coverage_floor").agg(F.count_if(hit).alias("hits"), F.count_if(near & ~hit).alias("near"))


# JSON -------------------------------------------------------------------------------------------

_RECORDS = """records AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed ' || event_id WHEN 'click' THEN '[' || event_id || ']'
    WHEN 'signup' THEN '{"' || event_type || '": ' || event_id || '}' ELSE props END AS t FROM events)"""


def _records(spark, d) -> DataFrame:
    e = B.table(spark, d, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    t = (
        F.when(kind == "error", F.concat(F.lit("failed "), n)).when(kind == "click", F.concat(F.lit("["), n, F.lit("]")))
        .when(kind == "signup", F.concat(F.lit('{"'), kind, F.lit('": '), n, F.lit("}"))).otherwise(F.col("props"))
    )
    per = e.select("user_id", "event_id", t.alias("t")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "t"))).alias("x"))
    return per.select("user_id", F.col("x.t").alias("texts"))


def _passed(rows: DataFrame, merge: bool) -> DataFrame:
    chunk = F.transform("texts", lambda t: F.struct(t.alias("text")))
    made = rows.select("user_id", E.passthrough_synthesis(chunk, merge=merge).alias("s"))
    facts = F.array_sort(F.transform(F.map_entries("s.facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return made.select("user_id", F.col("s.summary").alias("summary"), F.array_join(facts, ",").alias("facts"), F.size("s.claims").alias("n_claims"),
                       F.md5(F.array_join("s.claims", "|")).alias("claims"), F.size("s.used").alias("n_used"))


@query("json_passthrough_merge", f"""
WITH {_RECORDS}, kv AS (SELECT user_id, event_id, unnest(json_keys(t)) AS k, t FROM records WHERE t LIKE '{{%'),
f AS (SELECT user_id, k, arg_max(json_extract_string(t, k), event_id) AS v FROM kv GROUP BY ALL),
g AS (SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS facts FROM f GROUP BY user_id),
c AS (SELECT user_id, count(*) AS n, count_if(t NOT LIKE '{{%') AS m, string_agg(t, '|' ORDER BY event_id) FILTER (WHERE t NOT LIKE '{{%') AS b FROM records GROUP BY user_id)
SELECT user_id, n || ' record(s) from source.' AS summary, coalesce(facts, '') AS facts, CAST(m AS INTEGER) AS n_claims, md5(coalesce(b, '')) AS claims,
CAST(n AS INTEGER) AS n_used FROM c LEFT JOIN g USING (user_id)""")
def json_passthrough_merge(spark, d):
    return _passed(_records(spark, d), True)


@query("json_passthrough_separate", f"""
WITH {_RECORDS} SELECT user_id, count(*) || ' record(s) from source.' AS summary, '' AS facts, CAST(count(*) AS INTEGER) AS n_claims,
md5(string_agg(t, '|' ORDER BY event_id)) AS claims, CAST(count(*) AS INTEGER) AS n_used FROM records GROUP BY user_id""")
def json_passthrough_separate(spark, d):
    return _passed(_records(spark, d), False)


@query("tolerant_json", """
SELECT event_id, CASE WHEN event_id % 5 < 2 THEN props END AS body FROM events""")
def tolerant_json(spark, d):
    n, p = F.col("event_id") % 5, F.col("props")
    reply = (
        F.when(n == 0, p).when(n == 1, F.concat(F.lit("Here it is:\n"), p, F.lit(" done"))).when(n == 2, F.concat(F.lit("["), p, F.lit("]")))
        .when(n == 3, "no object").otherwise("null")
    )
    return B.table(spark, d, "events").select("event_id", J.tolerant_object(reply).alias("body"))


@query("citation_coercion", """
SELECT event_id, array_to_string(list_filter(CASE WHEN event_id % 9 IN (7, 1, 0) THEN list_filter([event_id % 9, 7, 1, 0], lambda x, i: i = 1 OR x <> event_id % 9)
ELSE [event_id % 9, 7, 1, 0] END, lambda x: x < event_id % 8 + 1), ',') AS used FROM events""")
def citation_coercion(spark, d):
    given = F.concat(F.lit("["), F.col("event_id") % 9, F.lit(', 1.5, true, "2", 7, -1, 1, 0, 1]'))
    kept = J.coerce_citations(given, F.col("event_id") % 8 + 1)
    return B.table(spark, d, "events").select("event_id", F.array_join(kept.cast("array<string>"), ",").alias("used"))


# Evidence ---------------------------------------------------------------------------------------

_SOURCES = """a AS (SELECT ascii(lang) AS qid, 0 AS source, doc_id AS pos, source AS artifact_id, text, 'v1' AS version FROM documents),
b AS (SELECT ascii(lang) AS qid, 1 AS source, -doc_id AS pos, source AS artifact_id, text, 'v2' AS version FROM documents WHERE n_chars > 1000)"""


def _two_sources(spark, d) -> list[DataFrame]:
    x = B.table(spark, d, "documents").withColumn("qid", F.ascii("lang")).withColumnRenamed("source", "artifact_id")
    cols = ["qid", "pos", "artifact_id", "text", "version"]
    first = x.withColumn("pos", F.col("doc_id")).withColumn("version", F.lit("v1")).select(*cols)
    return [first, x.where("n_chars > 1000").withColumn("pos", -F.col("doc_id")).withColumn("version", F.lit("v2")).select(*cols)]


@query("composite_dedup", f"""
WITH {_SOURCES}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, artifact_id, text ORDER BY source, pos) AS r FROM u)
SELECT CAST(qid AS INTEGER) AS qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY source, pos) - 1 AS INTEGER) AS pos, artifact_id, md5(text) AS body, version
FROM r WHERE r = 1""")
def composite_dedup(spark, d):
    first, second = _two_sources(spark, d)
    return E.compose([second, first][::-1]).select("qid", "pos", "artifact_id", F.md5("text").alias("body"), "version")


@query("evidence_augment", """
WITH x AS (SELECT source AS unit, doc_id, lang AS a, text, n_chars > 2000 AS old FROM documents),
n AS (SELECT unit, min(doc_id) AS doc_id, a, text FROM x WHERE NOT old AND NOT EXISTS (SELECT 1 FROM x y WHERE y.old AND y.unit = x.unit AND y.a = x.a AND y.text = x.text)
      GROUP BY unit, a, text),
e AS (SELECT unit, 0 AS part, doc_id, a, text FROM x WHERE old UNION ALL SELECT unit, 1, doc_id, a, text FROM n)
SELECT unit, CAST(count(*) AS INTEGER) AS n, md5(string_agg(a || md5(text), ',' ORDER BY part, doc_id)) AS body FROM e GROUP BY unit""")
def evidence_augment(spark, d):
    x = B.table(spark, d, "documents").withColumn("old", F.col("n_chars") > 2000)
    x = x.select(F.col("source").alias("unit"), "doc_id", F.col("lang").alias("artifact_id"), "text", "old")
    entry = F.concat("artifact_id", F.md5("text"))
    rows = E.augmented(x, "unit", "doc_id").select("unit", "part", "doc_id", entry.alias("entry"))
    listed = F.array_sort(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("part", "doc_id", "entry"))))
    per = rows.groupBy("unit").agg(F.count("*").cast("int").alias("n"), listed.alias("e"))
    body = F.when(F.size("e") > 0, F.md5(F.array_join(F.transform("e", lambda c: c["entry"]), ",")))
    return per.select("unit", "n", body.alias("body"))


@query("relevance_gate", f"""
SELECT doc_id, len(list_intersect({_tok('text')}, ['ouble', 'erung', 'ention'])) > 0 AS kept FROM documents""")
def relevance_gate(spark, d):
    kept = F.arrays_overlap(T.tokens(F.col("text")), F.array(*map(F.lit, ("ouble", "erung", "ention"))))
    return B.table(spark, d, "documents").select("doc_id", kept.alias("kept"))


@query("citations_to_spans", f"""
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
u AS (SELECT id, unnest([2, 0, 9, 2]) AS i, unnest([0, 1, 2, 3]) AS k FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem))
SELECT id, string_agg('part:' || l_partkey || {_HASH.format("'part ' || l_partkey")}, ',' ORDER BY k) AS spans FROM u JOIN l USING (id, i) GROUP BY id""")
def citations_to_spans(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    chunk = lambda r: F.struct(F.concat(F.lit("part:"), r["l_partkey"]).alias("artifact_id"), F.concat(F.lit("part "), r["l_partkey"]).alias("text"), F.lit("v1").alias("version"))
    spans = E.spans_of(E.cited(F.transform("x", chunk), F.array(*map(F.lit, (2, 0, 9, 2)))))
    return rows.select("id", F.array_join(F.transform(spans, lambda s: F.concat(s["artifact_id"], s["content_hash"])), ",").alias("spans"))


@query("materialize_stub", f"""
SELECT doc_id, 'cog:' || substr(sha1(lang || '|' || source), 1, 16) AS id, '[stub] decision-ready understanding for: ' || source AS summary,
       {_HASH.format('text')} AS span_hash, '[stub] decision-ready understanding for: ' || source AS digest FROM documents""")
def materialize_stub(spark, d):
    chunk = F.array(F.struct(F.lit("a").alias("artifact_id"), F.col("text").alias("text"), F.lit("v1").alias("version")))
    rows = B.table(spark, d, "documents").select("doc_id", F.col("lang").alias("namespace"), F.col("source").alias("query"), chunk.alias("chunks"))
    units = E.materialize(rows.withColumn("synthesis", E.stub_synthesis(F.col("query"), F.col("chunks"))).withColumn("namespace", F.concat_ws("#", "namespace", "doc_id")))
    named = units.select(F.split("namespace", "#")[1].cast("long").alias("doc_id"), F.split("namespace", "#")[0].alias("ns"), "query", "summary", "source_spans", "digest")
    return named.select("doc_id", T.unit_id(F.col("ns"), F.col("query")).alias("id"), "summary", F.col("source_spans")[0]["content_hash"].alias("span_hash"), "digest")


# Provenance -------------------------------------------------------------------------------------

_SPANS = f"""spans AS (SELECT l_orderkey AS unit, 'part:' || l_partkey AS artifact_id, 'v1' AS version,
    CASE WHEN l_returnflag = 'N' THEN {_HASH.format("'part ' || l_partkey")} ELSE '' END AS content_hash FROM lineitem
    UNION ALL SELECT l_orderkey, 'supplier:' || l_suppkey, NULL, NULL FROM lineitem)"""
_CHANGES = f"""changes AS (SELECT p_partkey AS event_seq, 'part:' || p_partkey AS artifact_id,
    CASE p_size % 5 WHEN 2 THEN 'v2' WHEN 3 THEN '' ELSE 'v1' END AS v,
    CASE p_size % 5 WHEN 0 THEN {_HASH.format("'part ' || p_partkey")} WHEN 1 THEN {_HASH.format("p_name")} ELSE '' END AS h,
    CASE p_size % 5 WHEN 4 THEN 'delete' ELSE 'update' END AS kind FROM part)"""
_ACTIONS = f"""{_SPANS}, {_CHANGES},
m AS (SELECT event_seq, unit, kind, bool_or(CASE WHEN coalesce(content_hash, '') <> '' AND h <> '' THEN content_hash <> h
      WHEN coalesce(version, '') <> '' AND v <> '' THEN version <> v ELSE true END) AS changed FROM changes JOIN spans USING (artifact_id) GROUP BY ALL),
actions AS (SELECT event_seq, unit, CASE WHEN kind = 'delete' THEN 'evict' WHEN changed THEN 'dirty' ELSE 'skip' END AS action FROM m)"""


@query("artifact_index", "SELECT DISTINCT 'part:' || l_partkey AS artifact_id, l_orderkey AS unit FROM lineitem UNION SELECT DISTINCT 'supplier:' || l_suppkey, l_orderkey FROM lineitem")
def artifact_index(spark, d):
    return O.artifact_index(B.order_units(spark, d))


@query("artifacts_per_unit", "SELECT l_orderkey AS id, CAST(count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey")
def artifacts_per_unit(spark, d):
    return B.order_units(spark, d).select("id", F.size(T.artifact_ids(F.col("source_spans"), F.col("observed_edges"))).alias("n"))


@query("entity_index", """
SELECT DISTINCT lower(e) AS entity, doc_id AS unit FROM (SELECT doc_id, unnest([source, lang, source]) AS e FROM documents)""")
def entity_index(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id", F.array(F.concat(F.lit(" "), F.upper("source")), "lang", F.lit("  "), "source").alias("entities"))
    return O.entity_index(rows, unit="doc_id")


@query("change_actions", f"WITH {_ACTIONS} SELECT * FROM actions")
def change_actions(spark, d):
    return O.change_actions(B.part_changes(spark, d), B.order_spans(spark, d))


@query("invalidate_summary", f"""
WITH {_ACTIONS} SELECT c.event_seq, count(unit) AS matched_units, count_if(action = 'dirty') AS dirtied, count_if(action = 'skip') AS skipped,
count_if(action = 'evict') AS deleted FROM changes c LEFT JOIN actions a ON a.event_seq = c.event_seq GROUP BY c.event_seq""")
def invalidate_summary(spark, d):
    changes = B.part_changes(spark, d)
    return O.change_summary(changes, O.change_actions(changes, B.order_spans(spark, d)))


@query("change_outcomes", f"""
WITH {_ACTIONS}, f AS (SELECT unit, min(CASE WHEN action = 'evict' THEN event_seq END) AS e, min(CASE WHEN action = 'dirty' THEN event_seq END) AS y FROM actions GROUP BY unit)
SELECT unit, CASE WHEN e IS NOT NULL THEN 'evicted' WHEN y IS NOT NULL THEN 'dirty' ELSE 'unchanged' END AS outcome, coalesce(e, y) AS event_seq FROM f""")
def change_outcomes(spark, d):
    return O.fold_actions(O.change_actions(B.part_changes(spark, d), B.order_spans(spark, d)))


def _change_query(name: str, where: str) -> None:
    @query(name, f"WITH {_ACTIONS} SELECT a.event_seq, unit, action FROM actions a JOIN part p ON p.p_partkey = a.event_seq WHERE {where}")
    def run(spark, d):
        keys = B.table(spark, d, "part").where(where).select(F.col("p_partkey").alias("event_seq"))
        return O.change_actions(B.part_changes(spark, d).join(keys, "event_seq"), B.order_spans(spark, d))


_change_query("invalidate_by_hash", "p_size % 5 IN (0, 1)")
_change_query("invalidate_by_version", "p_size % 5 = 2")
_change_query("invalidate_no_evidence", "p_size % 5 = 3")
_change_query("evict_on_delete", "p_size % 5 = 4")


@query("zero_match_events", "SELECT p_partkey AS event_seq FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def zero_match_events(spark, d):
    changes = B.part_changes(spark, d)
    return O.change_summary(changes, O.change_actions(changes, B.order_spans(spark, d))).where("matched_units = 0").select("event_seq")


def _users(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as units: the keys in their events are artifacts, the kinds of large values their entities."""
    e = B.table(spark, d, "events")
    arts = e.select(F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("artifact_id"), F.col("user_id").alias("unit")).distinct()
    ents = e.where("value > 30").select(F.col("event_type").alias("entity"), F.col("user_id").alias("unit")).distinct()
    units = e.groupBy(F.col("user_id").alias("unit")).agg(F.count("*").alias("n"))
    units = units.select("unit", F.lit("").alias("ns"), F.when(F.col("unit") % 4 == 0, "dirty").otherwise("fresh").alias("status"), F.col("unit").alias("seq"), "n")
    return units, ents, arts


_RELATED = """arts AS (SELECT DISTINCT user_id AS unit, json_extract_string(props, '$.k') AS k FROM events),
ents AS (SELECT DISTINCT user_id AS unit, event_type AS k FROM events WHERE value > 30),
pairs AS (SELECT seed, unit, min(relation) AS relation FROM (
    SELECT a.unit AS seed, b.unit, 'shared_entity' AS relation FROM ents a JOIN ents b ON a.k = b.k AND a.unit <> b.unit
    UNION ALL SELECT a.unit, b.unit, 'shared_source' FROM arts a JOIN arts b ON a.k = b.k AND a.unit <> b.unit) GROUP BY ALL)"""


@query("related_by_source", """
WITH arts AS (SELECT DISTINCT user_id AS unit, json_extract_string(props, '$.k') AS k FROM events)
SELECT DISTINCT a.unit AS seed, b.unit, 'shared_source' AS relation FROM arts a JOIN arts b ON a.k = b.k AND a.unit <> b.unit""")
def related_by_source(spark, d):
    units, ents, arts = _users(spark, d)
    return O.related_pairs(units.select(F.col("unit").alias("seed")), ents.limit(0), arts)


@query("related_by_entity", f"WITH {_RELATED} SELECT seed, unit, relation FROM pairs")
def related_by_entity(spark, d):
    units, ents, arts = _users(spark, d)
    return O.related_pairs(units.select(F.col("unit").alias("seed")), ents, arts)


@query("related_topk", f"""
WITH {_RELATED}, n AS (SELECT user_id AS unit, count(*) AS n FROM events GROUP BY user_id),
r AS (SELECT seed, p.unit, relation, 1.0 / (1 + abs(a.n - b.n)) AS score, row_number() OVER (PARTITION BY seed ORDER BY 1.0 / (1 + abs(a.n - b.n)) DESC, p.unit) AS k
      FROM pairs p JOIN n a ON a.unit = seed JOIN n b ON b.unit = p.unit WHERE p.unit % 4 <> 0)
SELECT seed, unit, relation, round(CAST(score AS DOUBLE), 6) AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""")
def related_topk(spark, d):
    units, ents, arts = _users(spark, d)
    units = units.withColumn("features", F.array(F.col("n").cast("double")))
    best = O.related_topk(units.select(F.col("unit").alias("seed")), ents, arts, units, lambda a, b: 1.0 / (1 + abs(a[:, 0, None] - b[:, 0])))
    return best.select("seed", "unit", "relation", F.round("score", 6).alias("score"), "rank")


# Freshness --------------------------------------------------------------------------------------


@query("ttl_expiry", """
SELECT event_id, epoch_us(TIMESTAMP '2024-01-20') / 1e6 - epoch_us(ts) / 1e6 > 864000.0 AS expired FROM events""")
def ttl_expiry(spark, d):
    now = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp")) / 1e6
    return B.activity(spark, d).select(F.col("seq").alias("event_id"), R.expired(F.col("us") / 1e6, now, F.lit(864000.0)).alias("expired"))


@query("ttl_revalidate", f"""
WITH {_SPANS}, c AS (SELECT 'part:' || p_partkey AS artifact_id, CASE p_size % 3 WHEN 0 THEN {_HASH.format("'part ' || p_partkey")} WHEN 1 THEN {_HASH.format("p_name")} END AS h FROM part),
x AS (SELECT unit, bool_or(CASE WHEN coalesce(content_hash, '') <> '' THEN content_hash <> h ELSE true END) AS changed FROM spans JOIN c USING (artifact_id) WHERE h IS NOT NULL GROUP BY unit)
SELECT o_orderkey AS unit, CASE WHEN coalesce(changed, false) THEN 'dirty' ELSE 'fresh' END AS status, CASE WHEN coalesce(changed, false) THEN 5.0 ELSE 100.0 END::DOUBLE AS freshness_epoch
FROM orders LEFT JOIN x ON unit = o_orderkey""")
def ttl_revalidate(spark, d):
    n = F.col("p_size") % 3
    now = F.when(n == 0, T.content_hash(F.concat(F.lit("part "), "p_partkey"))).when(n == 1, T.content_hash(F.col("p_name")))
    current = B.table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("artifact_id"), now.alias("text_hash"))
    units = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.lit(5.0).alias("freshness_epoch"))
    return R.revalidate(units, B.order_spans(spark, d), current, 100.0)


_LOG = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events),
log AS (SELECT user_id AS key, event_id AS seq, n % 7 AS content, CASE WHEN event_type = 'signup' THEN 'build' WHEN event_type IN ('view', 'click') THEN 'read'
        WHEN n >= 95 THEN 'delete' ELSE 'change' END AS kind FROM k),
reads AS (SELECT r.key, r.seq, (SELECT max(b.seq) FROM log b WHERE b.key = r.key AND b.kind = 'build' AND b.seq <= r.seq) AS built FROM log r WHERE kind = 'read'),
states AS (SELECT r.key, r.seq, CASE WHEN built IS NULL THEN 'unbuilt'
    WHEN EXISTS (SELECT 1 FROM log e WHERE e.key = r.key AND e.kind = 'delete' AND e.seq > built AND e.seq <= r.seq) THEN 'evicted'
    WHEN EXISTS (SELECT 1 FROM log e JOIN log b ON b.seq = built WHERE e.key = r.key AND e.kind = 'change' AND e.seq > built AND e.seq <= r.seq AND e.content <> b.content)
    THEN 'stale' ELSE 'fresh' END AS state FROM reads r)"""


@query("staleness_asof", f"WITH {_LOG} SELECT key, seq, state FROM states")
def staleness_asof(spark, d):
    return R.as_of(B.activity(spark, d))


@query("read_outcomes", f"WITH {_LOG} SELECT state, count(*) AS reads, count(DISTINCT key) AS keys FROM states GROUP BY state")
def read_outcomes(spark, d):
    return R.as_of(B.activity(spark, d)).groupBy("state").agg(F.count("*").alias("reads"), F.countDistinct("key").alias("keys"))


# Statistics -------------------------------------------------------------------------------------


@query("cache_stats", f"""
WITH {_LOG}, t AS (SELECT count(*) AS reads, count_if(state = 'fresh') AS hits, count_if(state = 'fresh' AND seq % 3 = 0) AS escalations FROM states)
SELECT (SELECT count(DISTINCT user_id) FROM events) AS units, (SELECT count(DISTINCT props) FROM events) AS tracked_artifacts, reads, hits, escalations,
round(escalations / hits, 3) AS escalation_rate, round(hits / reads, 3) AS hit_rate FROM t""")
def cache_stats(spark, d):
    reads = R.as_of(B.activity(spark, d)).withColumn("cache_hit", F.col("state") == "fresh").withColumn("escalated", F.col("cache_hit") & (F.col("seq") % 3 == 0))
    e = B.table(spark, d, "events").agg(F.countDistinct("user_id").alias("u"), F.countDistinct("props").alias("a")).first()
    return S.cache_stats(reads, e["u"], e["a"])


@query("store_stats", """
SELECT count(*) AS units, count_if(doc_id % 3 <> 0) AS fresh, count_if(doc_id % 3 = 0) AS dirty, (SELECT count(DISTINCT source) FROM documents) AS artifacts FROM documents""")
def store_stats(spark, d):
    x = B.table(spark, d, "documents").withColumn("status", F.when(F.col("doc_id") % 3 == 0, "dirty").otherwise("fresh"))
    return S.store_stats(x, x.select(F.col("source").alias("artifact_id")))


@query("unit_listing", r"""
SELECT doc_id, CASE WHEN length(f) <= 50 THEN f ELSE left(f, 47) || '...' END AS query, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place
FROM (SELECT doc_id, n_chars, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS f FROM documents)""")
def unit_listing(spark, d):
    x = B.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("query"), "n_chars")
    ordered = x.repartitionByRange(F.desc("n_chars"), F.col("doc_id")).sortWithinPartitions(F.desc("n_chars"), "doc_id")
    from ..base import written

    # Places in a global order without one task for all rows: a range's first place is the rows before it.
    parts = written(ordered.withColumn("part", F.spark_partition_id()), "listing")
    base = parts.groupBy("part").count().withColumn("base", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n_chars"), "doc_id"))
    return parts.withColumn("local", local).join(base, "part").select("doc_id", "query", (F.col("base") + F.col("local")).alias("place"))


@query("hit_query_history", """
WITH f AS (SELECT user_id, props, min(event_id) AS first_at FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at DESC) AS k FROM f)
SELECT user_id, string_agg(props, '|' ORDER BY first_at) AS recent FROM r WHERE k <= 16 GROUP BY user_id""")
def hit_query_history(spark, d):
    return S.recent(B.table(spark, d, "events"), "user_id", "props", "event_id", 16).select("user_id", F.array_join("recent", "|").alias("recent"))


@query("unit_touches", "SELECT user_id, count(*) AS hits, max(value) AS last_access FROM events GROUP BY user_id")
def unit_touches(spark, d):
    return S.touches(B.table(spark, d, "events"), "user_id", "value")


@query("store_latest_view", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)
SELECT user_id, event_id AS seq, f AS first_seq FROM r WHERE k = 1 AND event_type <> 'error'""")
def store_latest_view(spark, d):
    log = B.table(spark, d, "events").select("user_id", F.lit(1).alias("batch_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    return U.latest(log, "user_id").select("user_id", "seq", "first_seq")


@query("calibrate_thresholds", f"""
WITH s AS (SELECT a.label = b.label AS same, round({_cos('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
h AS (SELECT round_even((min(score) FILTER (WHERE same) + max(score) FILTER (WHERE NOT same)) / 2, 3) AS hit_threshold FROM s)
SELECT hit_threshold, round_even(greatest(0, hit_threshold - 0.05), 3) AS coverage_floor FROM h""")
def calibrate_thresholds(spark, d):
    """All pairs of one label as positives, all pairs of different labels as negatives."""
    return S.calibrate(pair_extremes(B.vectors(spark, d)))


@query("suggest_thresholds", f"""
WITH s AS (SELECT round({_cos('a.embedding', 'b.embedding')}, 9) AS score, row_number() OVER (ORDER BY round({_cos('a.embedding', 'b.embedding')}, 9)) AS r, count(*) OVER () AS n
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
h AS (SELECT round_even(least(0.9, score + 0.08), 3) AS hit_threshold FROM s WHERE r = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1)
SELECT hit_threshold, round_even(greatest(0, hit_threshold - 0.05), 3) AS coverage_floor FROM h""")
def suggest_thresholds(spark, d):
    return S.suggest(B.vectors(spark, d))


# Events -----------------------------------------------------------------------------------------


def _payloads(spark, d) -> DataFrame:
    """A webhook payload of each source in turn from the rows of ``part``."""
    p = B.table(spark, d, "part")
    k, name, brand = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    src = F.get(F.array(*map(F.lit, ("github", "deploy", "jira", "cdc"))), F.pmod("p_partkey", F.lit(4)).cast("int"))
    item = lambda a, v=None, kind=None: F.struct(a.alias("artifact_id"), F.lit(v).cast("string").alias("version"), F.lit(kind).cast("string").alias("kind"))
    commit = F.struct(F.array(k).alias("added"), F.array(name, F.lit("")).alias("modified"), F.array(brand, k).alias("removed"))
    body = (
        F.when(src == "github", F.to_json(F.struct(k.alias("after"), F.array(commit, commit).alias("commits"))))
        .when(src == "deploy", F.to_json(F.struct(F.when(F.col("p_size") > 5, brand).otherwise("").alias("service"), k.alias("version"))))
        .when(src == "jira", F.to_json(F.struct(F.struct(k.alias("key"), F.struct(name.alias("updated")).alias("fields")).alias("issue"))))
        .otherwise(F.to_json(F.struct(F.array(item(k), item(F.lit("")), item(brand, "v9", "delete")).alias("changes"))))
    )
    return p.select(F.col("p_partkey").alias("seq"), src.alias("source"), body.alias("payload"))


_EVENTS = """g AS (SELECT p_partkey AS seq, unnest(list_sort(list_distinct([CAST(p_partkey AS VARCHAR), p_name, p_brand]))) AS path, CAST(p_partkey AS VARCHAR) AS version FROM part WHERE p_partkey % 4 = 0),
all_events AS (
    SELECT seq, 'github:' || path AS artifact_id, version, 'github.push' AS kind FROM g
    UNION ALL SELECT p_partkey, 'deploy:' || p_brand, CAST(p_partkey AS VARCHAR), 'deploy' FROM part WHERE p_partkey % 4 = 1 AND p_size > 5
    UNION ALL SELECT p_partkey, 'jira:' || p_partkey, p_name, 'jira.update' FROM part WHERE p_partkey % 4 = 2
    UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), '', 'cdc' FROM part WHERE p_partkey % 4 = 3
    UNION ALL SELECT p_partkey, p_brand, 'v9', 'delete' FROM part WHERE p_partkey % 4 = 3)"""


def _event_query(name: str, kinds: str, sources: tuple[str, ...]) -> None:
    @query(name, f"WITH {_EVENTS} SELECT seq, artifact_id, version, kind FROM all_events WHERE kind IN ({kinds})")
    def run(spark, d):
        every = C.default_connectors()
        return C.events_of(_payloads(spark, d), {s: every[s] for s in sources}).select("seq", "artifact_id", "version", "kind")


_event_query("github_events", "'github.push'", ("github",))
_event_query("deploy_events", "'deploy'", ("deploy",))
_event_query("jira_events", "'jira.update'", ("jira",))
_event_query("cdc_events", "'cdc', 'delete'", ("cdc",))


@query("dispatch_all", f"WITH {_EVENTS} SELECT seq, artifact_id, version, kind FROM all_events")
def dispatch_all(spark, d):
    return C.Dispatcher().dispatch(_payloads(spark, d)).select("seq", "artifact_id", "version", "kind")


# Store ------------------------------------------------------------------------------------------


def _bodies(spark, d) -> DataFrame:
    """Units of documents as JSON: some without the later fields, some no JSON at all, some without provenance."""
    x = B.table(spark, d, "documents")
    p = F.struct(F.lit("m").alias("model_version"), F.lit("p").alias("prompt_version"),
                 F.array(F.struct(F.col("source").alias("artifact_id"), F.lit("v1").alias("version"), T.content_hash(F.col("text")).alias("content_hash"))).alias("source_spans"),
                 F.array().cast("array<string>").alias("observed_edges"))
    understanding = F.to_json(F.struct(F.col("source").alias("summary")))
    base = [F.concat(F.lit("cog:"), "doc_id").alias("id"), F.col("lang").alias("namespace"), F.col("text").alias("query"), understanding.alias("understanding")]
    old, new = F.to_json(F.struct(*base, p.alias("provenance"))), F.to_json(F.struct(*base, p.alias("provenance"), F.lit("dirty").alias("status"), F.col("n_chars").alias("hits")))
    n = F.col("doc_id") % 4
    body = F.when(n == 0, old).when(n == 1, new).when(n == 2, F.to_json(F.struct(*base))).otherwise("{broken")
    return x.select("doc_id", body.alias("body"))


@query("serde_roundtrip", f"""
SELECT 'cog:' || doc_id AS id, lang AS namespace, md5(text) AS query, {_HASH.format('text')} AS span_hash, CASE doc_id % 4 WHEN 1 THEN 'dirty' ELSE 'fresh' END AS status,
CAST(CASE doc_id % 4 WHEN 1 THEN n_chars ELSE 0 END AS BIGINT) AS hits FROM documents WHERE doc_id % 4 < 2""")
def serde_roundtrip(spark, d):
    units = U.from_json(U.to_json(U.from_json(_bodies(spark, d))))
    return units.select("id", "namespace", F.md5("query").alias("query"), F.col("provenance.source_spans")[0]["content_hash"].alias("span_hash"), "status", "hits")


@query("legacy_backfill", f"""
WITH t AS (SELECT doc_id, unnest({_tok('source')}) AS t FROM documents WHERE doc_id % 4 < 2), b AS (SELECT doc_id, {_BUCKET} AS bucket, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf * tf) AS n FROM b GROUP BY doc_id)
SELECT 'cog:' || doc_id AS id, bucket, round(tf / sqrt(n), 6) AS weight FROM b JOIN n USING (doc_id)""")
def legacy_backfill(spark, d):
    units = U.from_json(_bodies(spark, d)).where(F.size("understanding_embedding") == 0)
    digest = units.select("id", T.digest_text(F.get_json_object("understanding", "$.summary"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"),
                                              F.lit(None).cast("map<string,string>")).alias("digest"))
    rows = V.hashed_vectors(digest, ["id"], "digest").select("id", F.posexplode("vector").alias("bucket", "weight"))
    return rows.where("weight > 0").select("id", "bucket", F.round("weight", 6).alias("weight"))


# Sequences and streams --------------------------------------------------------------------------


@query("benchmark_report", r"""
WITH t AS (SELECT coalesce(text, '') AS old, doc_id % 5 < 2 AS moved FROM documents),
c AS (SELECT moved, CAST(len(regexp_extract_all(old, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n FROM t),
r AS (SELECT 'naive' AS system, unnest([n, n + CASE WHEN moved THEN 2 ELSE 0 END]) AS paid, true AS fresh FROM c
      UNION ALL SELECT 'no_invalidation', unnest([n, 0]), unnest([true, NOT moved]) FROM c
      UNION ALL SELECT 'cache', unnest([n, CASE WHEN moved THEN n + 2 ELSE 0 END]), true FROM c)
SELECT system, count(*) AS reads, CAST(count_if(fresh) AS BIGINT) AS correct, CAST(count_if(NOT fresh) AS BIGINT) AS stale, CAST(sum(paid) AS BIGINT) AS cost_tokens,
       count_if(fresh) / count(*) AS accuracy, count_if(NOT fresh) / count(*) AS stale_rate FROM r GROUP BY system""")
def benchmark_report(spark, d):
    from .benchmark import table_benchmark

    return table_benchmark(B.table(spark, d, "documents"))


def replay_log(spark, d) -> DataFrame:
    """User turns as reads, with what retrieval gives them, and changes of documents among them."""
    from ..streaming.replay import spread

    turns = B.turns(spark, d).withColumn("namespace", F.coalesce("namespace", F.lit("")))
    corpus = B.corpus(spark, d)
    found = retrievers.CorpusTable(corpus, 5).retrieve(turns.select("qid", "query", F.nullif("namespace", F.lit("")).alias("namespace")))
    chunk = F.struct("artifact_id", "text", "version")
    chunks = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    none = F.lit(None).cast("string")
    reads = turns.join(chunks, "qid", "left").select(
        "namespace", F.col("qid").alias("seq"), F.lit("read").alias("kind"), "query", "chunks",
        none.alias("artifact_id"), none.alias("content_hash"), none.alias("version"), none.alias("change_kind"),
    )
    kind = chunks.schema["chunks"].dataType
    changes = corpus.select(
        (F.col("seq") * 20 + 7).alias("seq"), F.lit("change").alias("kind"), none.alias("query"), F.lit(None).cast(kind).alias("chunks"), "artifact_id",
        F.when(F.col("seq") % 3 == 0, T.content_hash(F.col("text"))).otherwise(F.lit("")).alias("content_hash"), F.lit("v2").alias("version"),
        F.when(F.col("seq") % 10 == 9, "delete").otherwise("update").alias("change_kind"),
    )
    return reads.unionByName(spread(changes, turns.select("namespace")))


@query("replay_exact")
def replay_exact(spark, d):
    from ..streaming.replay import replay

    return replay(replay_log(spark, d))


@query("stream_invalidation", SQL["change_actions"])
def stream_invalidation(spark, d):
    from ..base import scratch_path
    from ..streaming.changes import stream_actions

    folder = scratch_path(spark, "stream")
    B.part_changes(spark, d).write.parquet(f"{folder}/in")
    changes = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    stream_actions(changes, B.order_spans(spark, d), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_seq", "unit", "action")


@query("read_batch", f"""
WITH {_TURNS}, {_TF},
qtf AS (SELECT qid, {_BUCKET} AS bucket, count(*) AS tf FROM (SELECT qid, unnest({_tok('query')}) AS t FROM turns) GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(tf * tf)) AS n FROM qtf GROUP BY qid),
reads AS (SELECT qid, turn, coalesce(namespace, '') AS ns, 'cog:' || substr(sha1(coalesce(namespace, '') || '|' || query), 1, 16) AS id FROM turns),
found AS (SELECT p.qid, least(5, count(DISTINCT x.doc_id)) AS n FROM turns p JOIN qtf q USING (qid) JOIN tf f USING (bucket) JOIN documents x ON x.doc_id = f.doc_id
    WHERE p.namespace IS NULL OR x.lang IS NULL OR p.namespace = x.lang GROUP BY p.qid),
dots AS (SELECT q.qid, u.qid AS unit_seq, sum(q.tf * u.tf) AS dot FROM qtf q JOIN qtf u USING (bucket) WHERE u.qid IN (SELECT qid FROM reads WHERE turn = 0) GROUP BY ALL),
scored AS (SELECT r.qid, u.qid AS unit_seq, u.id, round(coalesce(dot / (a.n * b.n), 0), 9) AS score FROM reads r JOIN reads u ON u.ns = r.ns AND u.turn = 0
    LEFT JOIN dots d ON d.qid = r.qid AND d.unit_seq = u.qid LEFT JOIN qn a ON a.qid = r.qid LEFT JOIN qn b ON b.qid = u.qid),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_seq) = 1),
state AS (SELECT r.qid, r.id AS new_id, b.id AS held_id, b.score, CASE WHEN b.score IS NULL OR b.score < 0.6 THEN 'miss' WHEN unit_seq % 3 = 0 THEN 'hit_stale' ELSE 'hit_fresh' END AS outcome
    FROM reads r LEFT JOIN best b USING (qid))
SELECT s.qid, outcome, CASE WHEN outcome = 'miss' THEN new_id ELSE held_id END AS unit_id, round(greatest(coalesce(score, 0), 0), 6) AS confidence,
    outcome = 'hit_fresh' AND score < 0.5 AS escalated, CAST(CASE WHEN outcome = 'hit_fresh' THEN 1 ELSE coalesce(n, 0) END AS INTEGER) AS n_evidence
FROM state s LEFT JOIN found USING (qid)""")
def read_batch(spark, d):
    """User turns against units built from earlier turns' texts: outcome, unit and evidence of each."""
    from .cache import read_batch as run

    turns = B.turns(spark, d)
    old = turns.where("turn = 0").select(F.col("qid").alias("unit_seq"), F.coalesce("namespace", F.lit("")).alias("namespace"), "query")
    units = V.hashed_vectors(old, ["unit_seq", "namespace", "query"], "query").select(
        "unit_seq", "namespace", T.unit_id(F.col("namespace"), F.col("query")).alias("id"), F.when(F.col("unit_seq") % 3 == 0, "dirty").otherwise("fresh").alias("status"),
        F.col("vector").alias("seed"), F.col("vector").alias("understanding"), F.array("vector").alias("claim_vectors"),
        F.array(F.struct(F.lit("turn").alias("artifact_id"), F.col("query").alias("text"), F.lit("v1").alias("version"))).alias("evidence"),
    )
    results, _ = run(turns, units, retrievers.CorpusTable(B.corpus(spark, d), 5))
    return results.select("qid", "outcome", "unit_id", F.round("confidence", 6).alias("confidence"), "escalated", F.size("evidence").alias("n_evidence"))
