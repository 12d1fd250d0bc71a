"""Language identification by Bayesian fusion of evidence.

log P(l | row) = tempered text log-likelihood + log P(declared language | l) + log P(address suffix | l)
                 + log prior of the host, up to a constant.

- Text: naive Bayes over hashed character trigrams of letters, fitted on labelled texts. Trigrams of a text
  depend on each other, so a text counts as at most ``tempered`` of them. A further class, "none of these",
  gives every trigram the same probability: a text it explains best is in no known language, whatever its labels.
- Declared language (the html element's ``lang``, or a column) and address suffix (top-level domain and a
  two-letter first path part): their tables are counted over all rows against the text's own verdicts.
- Host priors: counts per host are smoothed towards those of its registered domain, and these towards those
  of all rows; a row's own verdict is taken out of its host's counts. All counts are grouped aggregations.

Edge cases: a row without letters has no text evidence and counts in no table; without declared language,
suffix or host that evidence is not used; a row with no evidence at all, or in no known language, gets a null
language and confidence 0, and counts in no table; repeated rows are identified each; an empty table gives an empty result. ``carry`` names the columns to
keep; others are not read and can't clash.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, written
from .tokens import steps

BUCKETS = 1 << 15


@dataclass(frozen=True)
class Settings:
    """``per_language``: labelled texts that the text model is fitted on, for each language, on average."""

    per_language: int = 500
    smoothing: float = 0.5
    tempered: float = 60.0
    least_letters: int = 20
    host_weight: float = 10.0
    domain_weight: float = 20.0
    table_weight: float = 5.0


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def trigram_buckets(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text, in lower case, one blank between words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = np.where(c < 0x3000, _LETTERS[np.minimum(c, 0x2FFF)], True)
    c = np.where(letter, c, 32)
    c = np.concatenate([[32], c, [32]])
    c = c[(c != 32) | (np.concatenate([[0], c[:-1]]) != 32)]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * 0x1F1F1F + c[1:-1]) * 0x3D4D51 + c[2:]
    return (h * 0x9E3779B1 >> 15) & (BUCKETS - 1)


def fit_text_model(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None
) -> TextModel:
    """Fit on about ``per_language`` texts of each label, picked by a hash of the text; a label takes 128 KB of memory."""
    settings = settings or Settings()
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    languages = sorted(r["lang"] for r in sizes)
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col("lang") == r["lang"]) & (part < settings.per_language / r["count"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = np.bincount(trigram_buckets(text), minlength=BUCKETS)
                totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], ["lang", "bucket", "n"]
            )

    counted = rows.where(keep).mapInArrow(count, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS x languages rows
    table = np.zeros((BUCKETS, len(languages)))
    if len(found):
        column = np.array([languages.index(x) for x in found["lang"].to_pylist()])
        table[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
    table += settings.smoothing
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style")}


def page_text(html: str) -> str:
    """What a reader sees of a page, roughly: without tags, scripts, styles and comments.

    One scan forward: an end that isn't found once is not looked for again.
    """
    out, at, missing = [], 0, set()

    def end_of(what: str, start: int) -> int:
        if what in missing:
            return -1
        if what in _CLOSE:
            found = _CLOSE[what].search(html, start)
            end = found.end() if found else -1
        else:
            end = html.find(what, start)
            end = end + len(what) if end >= 0 else -1
        if end < 0:
            missing.add(what)
        return end

    while (start := html.find("<", at)) >= 0:
        end, opened = -1, _OPEN.match(html, start)
        if opened:
            end = end_of(opened[1].lower(), opened.end())
        elif html.startswith("<!--", start):
            end = end_of("-->", start + 4)
        if end < 0:
            end = end_of(">", start + 1)
        if end < 0:
            break
        out += [html[at:start], " "]
        at = end
    return html_entities.unescape("".join(out) + html[at:])


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, registered domain (its last two parts) and suffix of a URL."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower())
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0]
    if not host:
        return None, None, None
    parts = host.split(".")
    first = path.split("/", 1)[0]
    return host, ".".join(parts[-2:]), parts[-1] + ("/" + first if re.fullmatch("[a-z]{2}", first) else "")


def _evidence(
    rows: DataFrame, model: TextModel, settings: Settings, carry: list[str], text_col: str | None, html_col: str | None,
    url_col: str | None, declared_col: str | None, host_col: str | None, with_text: bool,
) -> DataFrame:
    """carry, the text if asked for, declared, suffix, host, domain, own (text's verdict or null), own_p (its probability by the text alone),
    foreign (the text is in no known language) and the text's log-likelihoods."""
    ship(rows.sparkSession)
    none = F.lit(None).cast("string")
    column = lambda c: F.col(f"`{c}`").cast("string") if c else none
    source = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(0).alias("_")).alias("row"), column(text_col or html_col).alias("text"),
        column(url_col).alias("url"), F.lower(column(declared_col)).alias("declared"), column(host_col).alias("host"),
    )
    known = rows.sparkSession.sparkContext.broadcast(model.log_p)  # BUCKETS x languages, 8 MB at most
    width, tempered, least = len(model.languages), settings.tempered, settings.least_letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = known.value
        for batch in batches:
            for part in steps(batch):
                declared, suffix, host, domain, own, own_p, foreign, scores = [], [], [], [], [], [], [], []
                for text, url, said, site in zip(*(part.column(c).to_pylist() for c in ("text", "url", "declared", "host"))):
                    text = text or ""
                    if html_col:
                        found = _DECLARED.search(text)
                        said = found[1].lower() if found else said
                        text = page_text(text)
                    h, d, s = address(url) if url_col else (site, site, None)
                    grams = trigram_buckets(text)
                    score, other = np.zeros(width), -np.inf
                    if len(grams) and width:
                        counted = min(1.0, tempered / len(grams))
                        score = log_p[grams].sum(axis=0, dtype=np.float64) * counted
                        other = -np.log(BUCKETS) * len(grams) * counted - score.max()
                        score -= score.max()
                    enough = len(grams) >= least and width > 0
                    declared.append(said)
                    suffix.append(s)
                    host.append(h)
                    domain.append(d)
                    foreign.append(enough and other > 0)
                    own.append(int(score.argmax()) if enough and other <= 0 else None)
                    own_p.append(float(1 / (np.exp(score).sum() + np.exp(other))) if enough and other <= 0 else None)
                    scores.append(score.tolist())
                own_text = [part.column("text")] if with_text else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *own_text, *(pa.array(x, pa.string()) for x in (declared, suffix, host, domain)),
                     pa.array(own, pa.int32()), pa.array(own_p, pa.float64()), pa.array(foreign, pa.bool_()),
                     pa.array(scores, pa.list_(pa.float64()))],
                    ["row", *(["text"] if with_text else []), "declared", "suffix", "host", "domain", "own", "own_p", "foreign", "scores"],
                )

    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"row {row}, {'text string, ' if with_text else ''}declared string, suffix string, host string, domain string, own int, own_p double, foreign boolean, scores array<double>",
    )


def _counted(rows: DataFrame, key: str | None, width: int) -> DataFrame:
    counts = F.array(*(F.sum(F.when(F.col("own") == k, 1).otherwise(0)) for k in range(width)))
    rows = rows.where("own IS NOT NULL")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(counts.alias("c")) if key else rows.agg(counts.alias("c"))


def _smoothed(counts: Column, base: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, base, lambda c, b: (c + weight * b) / (total + weight))


RESULTS = ("detected", "confidence", "text_detected", "text_confidence", "declared")


def identify(
    rows: DataFrame, model: TextModel, carry: list[str], text_col: str | None = None, html_col: str | None = None,
    url_col: str | None = None, declared_col: str | None = None, host_col: str | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """The ``carry`` columns of each row, with detected (language), confidence, text_detected, text_confidence and declared.

    A result whose name is carried gets underscores.
    """
    settings = settings or Settings()
    width = len(model.languages)
    if not width:
        kept = [F.col(f"`{c}`") for c in carry]
        none = F.lit(None).cast("string")
        results = (none, F.lit(0.0), none, none.cast("double"), none)
        return rows.select(*kept, *(x.alias(free_name(n, carry)) for n, x in zip(RESULTS, results)))
    once = text_col if text_col in carry and rows.schema[text_col].dataType.simpleString() == "string" else None
    others = [c for c in carry if c != once]  # a text that is carried goes to the workers once
    found = _evidence(rows, model, settings, others, text_col, html_col, url_col, declared_col, host_col, once is not None)
    found = written(found, "evidence")
    slim = found.select("declared", "suffix", "host", "domain", "own")
    overall = list(_counted(slim, None, width).first()["c"])  # one row
    overall = [float(x or 0) for x in overall]
    base = F.array(*(F.lit((x + 1.0) / (sum(overall) + width)) for x in overall))
    domains = _counted(slim, "domain", width).select(F.col("domain").alias("_domain"), _smoothed(F.col("c"), base, settings.domain_weight).alias("p"))
    hosts = slim.where("own IS NOT NULL AND host IS NOT NULL").groupBy("host", "domain")
    hosts = hosts.agg(F.array(*(F.sum(F.when(F.col("own") == k, 1).otherwise(0)) for k in range(width))).alias("host_counts"))
    hosts = hosts.join(domains, hosts["domain"] == domains["_domain"])
    # Tables: written, so that their sizes are known and joins broadcast only what is small.
    hosts = written(hosts.select(F.col("host").alias("_host"), "host_counts", F.col("p").alias("domain_p")), "hosts")
    tables = {}
    for key in ("declared", "suffix"):
        c = _counted(slim, key, width)
        share = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / max(1.0, sum(overall))
        of = F.array(*(F.lit(x) for x in overall))
        given = F.zip_with(F.col("c"), of, lambda a, n: (a + settings.table_weight * share) / (n + settings.table_weight))
        tables[key] = written(c.select(F.col(key).alias(f"_{key}"), given.alias(f"{key}_p")), key)
    out = found.join(hosts, found["host"] == hosts["_host"], "left")
    for key, table in tables.items():
        out = out.join(table, F.col(key) == F.col(f"_{key}"), "left")
    flat = F.array(*(F.lit(1.0) for _ in range(width)))
    others = F.transform("host_counts", lambda c, k: c - F.when(F.col("own") == k, 1).otherwise(0))
    prior = F.coalesce(_smoothed(others, F.col("domain_p"), settings.host_weight), base)
    total = F.zip_with("scores", prior, lambda s, p: s + F.log(p))
    for key in tables:
        total = F.zip_with(total, F.coalesce(F.col(f"{key}_p"), flat), lambda s, p: s + F.log(p))
    out = out.withColumn("_total", total).withColumn("_most", F.array_max("_total"))
    weights = F.aggregate(F.transform("_total", lambda x: F.exp(x - F.col("_most"))), F.lit(0.0), lambda s, x: s + x)
    names = F.array(*(F.lit(x) for x in model.languages))
    any_evidence = F.coalesce(F.col("own").isNotNull() | F.col("declared_p").isNotNull() | F.col("suffix_p").isNotNull() | F.col("host_counts").isNotNull(), F.lit(False)) & ~F.col("foreign")
    best = F.get(names, F.array_position("_total", F.col("_most")).cast("int") - 1)
    sure = F.when(any_evidence, 1 / weights).otherwise(F.lit(0.0))
    results = (F.when(any_evidence, best), sure, F.get(names, F.col("own")), F.col("own_p"), F.col("declared"))
    return out.select(
        *(F.col("text").alias(c) if c == once else F.col("row").getField(c).alias(c) for c in carry),
        *(x.alias(free_name(n, carry)) for n, x in zip(RESULTS, results)),
    )


