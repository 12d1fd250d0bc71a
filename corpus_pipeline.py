"""The corpus pipeline: quality rules, language, repeated lines, near duplicates, then packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps of
``docs`` with the columns of documents, the last one the packed pieces. ``run`` applies them in order, each
stage's rows written as Parquet and read again.

- quality_rules: documents that the rules reject go (operator 9).
- language_id: documents without a language go, also those in none of the corpus's languages, and those whose
  text and labels don't agree on one (operator 6).
- line_dedup: later occurrences of repeated three-line windows go from the texts; a document of which no
  word is left goes too, its lines are all in earlier documents (operator 1).
- near_duplicates: of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays
  (operator 4).
- packing: pieces of at most 2048 tokens in as few sequences as best fit finds (operator 3).

Null ids: such documents pass the stages by their text; in the fourth, those of equal texts are one document.
Rows that repeat an id and a text are one document to the fourth stage, of which one row stays; another text of
an id is a document of its own. Null and empty texts fail the quality rules. Empty tables give empty stages.
Further columns pass as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written
from tidemark.llm.language_id import fit_text_model, identify
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import Join, ngram_join
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.queries import tokenizer_file

#: Below this probability a document's language counts as unknown.
LEAST_CONFIDENCE = 0.5
#: Ids of documents to drop that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by their places, which no operator's results are, and the name of each."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rows, names = _numbered(docs)
    found = quality_rules(rows, text_col=names["text"], lang_col=names["lang"])
    return found.where("kept").select(*rows.columns).toDF(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles, and whose text doesn't contradict the declared one."""
    model = fit_text_model(docs)
    rows, names = _numbered(docs)
    found = identify(rows, model, rows.columns, text_col=names["text"], declared_col=names["lang"], host_col=names["source"])
    sure = F.col("detected").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE)
    against = (F.col("text_confidence") >= LEAST_CONFIDENCE) & (F.lower("text_detected") != F.lower(F.col(names["lang"]).cast("string")))
    return found.where(sure & ~F.coalesce(against, F.lit(False))).select(*rows.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of three-line windows, as far as a word is left; n_chars follows the text."""
    rows, names = _numbered(docs)
    text = names["text"]
    cleaned = line_dedup(rows, id_col=names["doc_id"], text_col=text)
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*rows.columns)
    if "n_chars" in names:
        cleaned = cleaned.withColumn(names["n_chars"], F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return cleaned.toDF(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """(_key, _text, row): a key is a document's id; null ids, and further texts of an id, have stand-ins after all ids in use."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.struct("*").alias("row"))
    digest = F.xxhash64("_text")
    texts = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.min(digest).alias("_first"), F.max(digest).alias("_last"))
    several = written(texts.where("_first <> _last").select(F.col("_id").alias("_of"), "_first"), "ids-of-several-texts")
    n = several.count()
    stand_in = lambda *of: F.xxhash64(*of).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    key = F.coalesce("_id", stand_in("_text"))  # copies without id are one document, too
    if n:
        rows = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, F.col("_id") == F.col("_of"), "left")
        key = F.when(digest != F.col("_first"), stand_in("_id", "_text")).otherwise(key)
    return rows.select(key.alias("_key"), "_text", "row")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle links, the one with the smallest id."""
    keyed = _keyed(docs)
    found = ngram_join(keyed, "_key", "_text", Join(n=5, num=80, den=100))
    found = written(found.select(F.col("doc_id").alias("_id"), "component_id"), "components")
    gone = found.where("_id <> component_id").select("_id").distinct()
    small = gone.count() <= BROADCAST_ROWS  # ids alone; beyond, texts are shuffled to them
    kept = keyed.join(F.broadcast(gone) if small else gone, F.col("_key") == F.col("_id"), "left_anti")
    twice = found.where("_id = component_id").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    if not twice.isEmpty():  # rows of one id and text: one stays
        same = kept.join(twice, F.col("_key") == F.col("_id"), "left_semi")
        first = same.groupBy("_key", F.sha2("_text", 256).alias("_text")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(twice, F.col("_key") == F.col("_id"), "left_anti").select("row").unionByName(first.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The tokenizer, language model and packing are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
