"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier
from .ann import search
from .bpe import encode
from .collocations import collocations
from .language_id import fit_text_model, identify
from .line_dedup import line_dedup
from .lloyd import clustered
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .token_store import round_trip
from .warc import round_trip as archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document."""
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document: encoded, then decoded from the ids."""
    docs, vocabulary = _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json")
    both = encode(docs, vocabulary, decoded_col="text")
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each piece of each document."""
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, and n_links."""
    return ngram_join(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, text_score, meta_score and kept of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared and identified of every page; the text model is fitted on documents."""
    model = fit_text_model(_table(spark, sf_dir, "documents"))
    found = identify(_table(spark, sf_dir, "pages"), model, ["page_id"], html_col="html", url_col="url")
    return found.select(
        "page_id", F.col("detected").alias("lang"), "confidence", F.col("text_detected").alias("text_lang"), "declared",
        (F.col("detected").isNotNull() & (F.col("confidence") >= 0.5)).alias("identified"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each page, from the archives read back."""
    found = archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, from the files read back."""
    found = round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and verdicts of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's five nearest of each query."""
    return search(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document."""
    found = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", F.col("n_words").cast("long"), F.col("n_removed").cast("long"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each vector."""
    return clustered(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's first 2000 phrases of each language."""
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_token_store": op8_token_store,
    "op9_quality_rules": op9_quality_rules,
    "op10_ann": op10_ann,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_collocations": op13_collocations,
}



def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and means over (vector, component) rows."""
    parts = [f"""WITH valid AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, embedding AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT v, j, CAST(floor(256 * CAST(e[j] AS DOUBLE)) AS BIGINT) AS x FROM valid, range(1, 65) AS s(j)),
first AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM valid QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN x USING (v))"""]
    near = """d{0} AS (SELECT v, c, sum((x.x - m.x) * (x.x - m.x)) AS d FROM x JOIN c{0} m USING (j) GROUP BY v, c),
a{0} AS MATERIALIZED (SELECT v, c, d FROM d{0} QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)"""
    for i in range(rounds):
        parts += [near.format(i), f"""m{i + 1} AS (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM a{i} JOIN x USING (v) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c, j, CAST(coalesce(m.x, o.x) AS BIGINT) AS x FROM c{i} o LEFT JOIN m{i + 1} m USING (c, j))"""]
    parts.append(near.format(rounds))
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN valid USING (v)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h ON h.c = a.c"""


SQL = {
    "op11_substring_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT k, p, array_to_string(w[p : p + 34], ' ') AS body FROM (SELECT k, w, unnest(generate_series(1, len(w) - 34)) AS p FROM docs)),
twice AS MATERIALIZED (SELECT k, p FROM windows QUALIFY count(*) OVER (PARTITION BY body) > 1),
gone AS (SELECT DISTINCT k, p + i AS pos FROM twice, range(35) AS s(i)),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (k, pos) GROUP BY k),
counts AS (SELECT k, count(*) AS n_removed FROM gone GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (k) LEFT JOIN counts USING (k)""",
    "op12_centroid_clustering": _lloyd_sql(),
    "op13_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS MATERIALIZED (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
flat AS (SELECT p, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM cut),
runs AS MATERIALIZED (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM flat WINDOW o AS (PARTITION BY p ORDER BY pos)),
grams AS (SELECT lang, 1 AS k, w1 AS phrase FROM runs UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
          UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, phrase, f AS a, k AS size, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
gone AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM candidates, range(1, 3) AS s(i) WHERE size = 3 GROUP BY ALL),
cuts AS (SELECT c.*, k FROM candidates c, range(1, 3) AS s(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, a, c.k, l.f AS l, r.f AS r, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS score
           FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[: c.k], ' ')
           JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[c.k + 1 :], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM lowest x LEFT JOIN gone g USING (lang, phrase) JOIN totals USING (lang)
WHERE g.longer IS NULL OR 100 * g.longer < 50 * a QUALIFY rank <= 2000""",
    "op1_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
bare AS (SELECT doc_id, pos, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS b FROM lines),
full_lines AS (SELECT doc_id, pos, b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
                      count(*) OVER (PARTITION BY doc_id) AS n FROM bare WHERE b <> ''),
windows AS (SELECT doc_id, pos AS first_line, n, k,
    b || CASE WHEN n > 1 THEN chr(10) || lead(b, 1) OVER w ELSE '' END
      || CASE WHEN n > 2 THEN chr(10) || lead(b, 2) OVER w ELSE '' END AS body,
    CASE WHEN n = 1 THEN pos WHEN n = 2 THEN lead(pos, 1) OVER w ELSE lead(pos, 2) OVER w END AS last_line
    FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
whole AS (SELECT doc_id, first_line, last_line, body FROM windows WHERE body IS NOT NULL AND last_line IS NOT NULL
          UNION ALL SELECT doc_id, pos, pos, b FROM full_lines WHERE n > 1 AND len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) > 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) AS r FROM whole),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN ranked r
         ON r.doc_id = l.doc_id AND r.r > 1 AND l.pos BETWEEN r.first_line AND r.last_line),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS k
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
         WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT c.doc_id, coalesce(k.text, '') AS text,
       CAST(CASE WHEN d.text = '' THEN 0 ELSE len(c.lines) END AS BIGINT) AS n_lines,
       CAST(len(c.lines) - coalesce(k.k, 0) AS BIGINT) AS n_removed
FROM cut c JOIN docs d USING (doc_id) LEFT JOIN kept k ON k.doc_id = c.doc_id""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
flat AS (SELECT doc_id, len(w) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, k, pos, CASE WHEN k = 1 THEN word WHEN k = 2 THEN
    word || ' ' || lead(word, 1) OVER o ELSE word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o END AS g
    FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE g IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id,
       CAST((SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS BIGINT) AS n_links
FROM docs d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, s.n""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op9_quality_rules": r"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
          list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS lw,
          list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
grams AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
          FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM
            (SELECT DISTINCT doc_id, pos + k AS pos FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1) GROUP BY doc_id),
base AS (SELECT doc_id, lang, lw, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(text) AS total,
    length(regexp_replace(text, '[^A-Z\x{00C0}-\x{00D6}\x{00D8}-\x{00DE}\x{0391}-\x{03A9}\x{0410}-\x{042F}]+', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits,
    length(regexp_replace(text, '[^!-/:-@\[-`{-~\x{00A1}-\x{00BF}\x{2010}-\x{205E}\x{3001}-\x{3003}]+', '', 'g')) AS marks
    FROM words LEFT JOIN repeats USING (doc_id)),
spread AS (SELECT lang, unnest(lw) AS word FROM base),
counts AS (SELECT lang, word, count(*) AS n FROM spread WHERE lang IS NOT NULL GROUP BY ALL
           UNION ALL SELECT NULL, word, count(*) FROM spread GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
common AS (SELECT c.lang, word, n / total AS q FROM
           (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts) c
           JOIN totals t ON t.lang IS NOT DISTINCT FROM c.lang WHERE r <= 32),
bins AS (SELECT lang, count(*) AS k FROM common GROUP BY lang),
sized AS (SELECT lang, count(*) AS n_docs FROM base WHERE n_words > 0 AND lang IS NOT NULL GROUP BY lang
          UNION ALL SELECT NULL, count(*) FROM base WHERE n_words > 0),
noise AS (SELECT b.lang, b.k AS bins, n_docs FROM bins b JOIN sized s ON s.lang IS NOT DISTINCT FROM b.lang),
kinds AS (SELECT doc_id, lang, n_words, k, CAST(c AS DOUBLE) AS c FROM base, LATERAL (VALUES
    (0, word_chars - capitals - digits - marks), (1, capitals), (2, digits), (3, total - word_chars), (4, n_symbols),
    (5, marks - n_symbols)) AS v(k, c)),
per_lang AS (SELECT lang, k, sum(c) AS c FROM (SELECT lang, k, c FROM kinds WHERE lang IS NOT NULL
             UNION ALL SELECT NULL, k, c FROM kinds) GROUP BY lang, k),
class_q AS (SELECT lang, k, c / sum(c) OVER (PARTITION BY lang) AS q FROM per_lang),
class_p AS (SELECT doc_id, lang, n_words, k, c / nullif(sum(c) OVER (PARTITION BY doc_id), 0) AS p FROM kinds WHERE n_words >= 50),
hits AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(lw) AS word FROM base) GROUP BY ALL),
word_p AS (SELECT b.doc_id, b.lang, b.n_words, c.word, coalesce(h.c, 0) / b.n_words AS p, c.q FROM base b
           JOIN common c ON c.lang IS NOT DISTINCT FROM b.lang
           LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.word = c.word WHERE b.n_words >= 50),
word_all AS (SELECT doc_id, lang, n_words, p, q FROM word_p UNION ALL
             SELECT doc_id, lang, n_words, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM word_p GROUP BY ALL),
pairs AS (SELECT doc_id, p.lang, n_words, 'c' AS kind, p, q FROM class_p p JOIN class_q q ON q.lang IS NOT DISTINCT FROM p.lang AND q.k = p.k
         UNION ALL SELECT doc_id, lang, n_words, 'w', p, q FROM word_all),
distance AS (SELECT doc_id, kind, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END)
    - max(CASE kind WHEN 'c' THEN 5 ELSE bins END * (1 / n_words + 1 / n_docs) / (8 * ln(2))))) AS d
    FROM pairs x JOIN noise n ON n.lang IS NOT DISTINCT FROM x.lang GROUP BY ALL),
over_limit AS (SELECT DISTINCT doc_id FROM distance WHERE d > CASE kind WHEN 'c' THEN 0.28 ELSE 0.30 END),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over_limit) AS kept FROM failed""",
}
