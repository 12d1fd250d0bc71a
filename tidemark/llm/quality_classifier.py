"""Quality classifier by co-training of a text view and a metadata view.

Two logistic classifiers see different sides of a document: its text (hashed word shares and shape: kinds
of characters, word and line lengths, repetition) and its metadata (source, language, length class). Both
start from a bounded sample of labelled rows. In each round each view labels the unlabelled documents it is
surest of, which the other view then trains on too. At the end each view is calibrated on held-out labels
(Platt), the calibrated views are combined by weights fitted on the same rows, and all documents are scored.

``Settings`` bounds the labelled and unlabelled rows that fitting sees (features only, collected to the
driver); scoring runs over every row, whole texts. Picking is by hash of the id, so it doesn't depend on
partitions.

Edge cases: null or empty text has zero features and is scored from metadata and bias; nulls in metadata
are a value of their own; documents labelled both ways count for both; with labels of one kind only, or
none, the score is that kind's (without labels 0.5, which is kept); repeated rows are scored each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import steps

HASHED, SHAPE, META = 512, 16, 128


@dataclass(frozen=True)
class Settings:
    labelled: int = 6_000
    unlabelled: int = 6_000
    rounds: int = 4
    per_round: int = 300
    sure: float = 0.95
    held_out: float = 0.25
    keep_at: float = 0.5
    penalty: float = 2e-2


def text_features(texts: list[str | None]) -> np.ndarray:
    """Features of texts: square roots of hashed word shares, then shape."""
    out = np.zeros((len(texts), HASHED + SHAPE), np.float32)
    raw = [(x or "").encode() for x in texts]
    split = [x.lower().split() for x in raw]
    sizes = [len(x) for x in split]
    if not sum(sizes):
        return out
    coded = pa.array((w for x in split for w in x), pa.binary(), size=sum(sizes)).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    bucket = np.fromiter((zlib.crc32(w) % HASHED for w in distinct), np.int64, len(distinct))
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    codes = coded.indices.to_numpy()
    at = 0
    for k, n in enumerate(sizes):
        if not n:
            continue
        own = codes[at : at + n]
        at += n
        out[k, :HASHED] = np.sqrt(np.bincount(bucket[own], minlength=HASHED) / n)
        kinds = np.bincount(np.frombuffer(raw[k], np.uint8), minlength=256)
        total = kinds.sum()
        lines = raw[k].split(b"\n")
        filled = [x for x in lines if x.strip()]
        counts = np.unique(own, return_counts=True)[1]
        share = lambda *codes: sum(kinds[list(c)].sum() for c in codes) / total
        out[k, HASHED:] = [
            share(range(65, 91)), share(range(97, 123)), share(range(48, 58)), share(range(128, 256)),
            share(b"#*$%&|<>"), share(b".,;:!?"), share(b"!"), share(b"|"), share(b"\n"), length[own].mean() / 10,
            len(counts) / n, counts.max() / n, (own[1:] == own[:-1]).mean() if n > 1 else 0.0,
            1 - len(set(filled)) / max(1, len(filled)), np.log1p(n) / 10, np.log1p(total / max(1, len(lines))) / 10,
        ]
    return out


def meta_features(columns: list[list], n_chars: list[int | None]) -> np.ndarray:
    """Hashed one-hot features of metadata columns and the length's class."""
    out = np.zeros((len(n_chars), META), np.float32)
    for i, values in enumerate(columns):
        for k, x in enumerate(values):
            out[k, zlib.crc32(f"{i}={x}".encode()) % (META - 16)] = 1
    for k, n in enumerate(n_chars):
        out[k, META - 16 + min(15, int(np.log2(1 + max(0, n or 0))))] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a logistic regression with standardised inputs, by Nesterov's gradient method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    w = last = np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    rate = 4.0 / (1 + float((weight[:, None] * z * z).sum()))
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - last)
        off = weight * (1 / (1 + np.exp(-np.clip(z @ ahead[:-1] + ahead[-1], -30, 30))) - y)
        slope = np.append(off @ z + penalty * ahead[:-1], off.sum())
        last, w = w, ahead - rate * slope * 5
    out = w[:-1] / scale
    return np.append(out, w[-1] - out @ mean)


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass(frozen=True)
class Model:
    text: np.ndarray | None
    meta: np.ndarray | None
    text_scale: np.ndarray | None
    meta_scale: np.ndarray | None
    both: np.ndarray | None
    constant: float = 0.5

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score and the two calibrated views."""
        if self.text is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        a = _logit(_logit(text, self.text)[:, None], self.text_scale)
        b = _logit(_logit(meta, self.meta)[:, None], self.meta_scale)
        return _p(_logit(np.stack([a, b], axis=1), self.both)), _p(a), _p(b)


def co_train(
    text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray,
    settings: Settings,
) -> Model:
    """Fit on labelled rows (label 0 or 1) but those ``held`` out, and on unlabelled ones as the views label them."""
    if len(np.unique(label[~held])) < 2 or len(np.unique(label[held])) < 2:
        return Model(None, None, None, None, None, float(label.mean()) if len(label) else 0.5)
    views, pool = [text[~held], meta[~held]], [more_text, more_meta]
    given: list[dict[int, int]] = [{}, {}]  # what each view was told about the pool

    def fit(v: int) -> np.ndarray:
        rows = np.fromiter(given[v], np.int64, len(given[v]))
        x = np.concatenate([views[v], pool[v][rows]])
        y = np.concatenate([label[~held], np.fromiter(given[v].values(), np.float64, len(rows))])
        weight = np.concatenate([np.ones(len(views[v])), np.full(len(rows), 0.5)])
        share = max(1e-3, float((weight * y).sum() / weight.sum()))
        even = weight * np.where(y == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share))
        return fit_logistic(x, y, even, penalty=settings.penalty * max(1.0, 1000 / len(y)))

    ties = np.random.default_rng(11).permutation(len(more_text))  # so that equal rows of the pool are taken in no order
    weights = [fit(0), fit(1)]
    for _ in range(settings.rounds):
        for v in (0, 1):
            if not len(pool[v]):
                continue
            p = _p(_logit(pool[v], weights[v]))
            for kind, sure in ((1, p), (0, 1 - p)):
                new = np.ones(len(pool[v]), bool)
                new[np.fromiter(given[1 - v], np.int64, len(given[1 - v]))] = False
                new = np.flatnonzero(new & (sure >= settings.sure))
                best = new[np.lexsort((ties[new], -sure[new]))[: settings.per_round]]
                given[1 - v].update({int(i): kind for i in best})
        weights = [fit(0), fit(1)]
    raw = [_logit(text[held], weights[0]), _logit(meta[held], weights[1])]
    even = np.ones(held.sum())
    scales = [fit_logistic(r[:, None], label[held], even, 1e-4, 400) for r in raw]
    calibrated = np.stack([_logit(r[:, None], s) for r, s in zip(raw, scales)], axis=1)
    return Model(weights[0], weights[1], scales[0], scales[1], fit_logistic(calibrated, label[held], even, 1e-4, 400))


def _viewed(docs: DataFrame, id_col: str, text_col: str, meta_cols: list[str]) -> DataFrame:
    text = F.col(text_col).cast("string")
    meta = [F.col(c).cast("string").alias(f"meta_{i}") for i, c in enumerate(meta_cols)]
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *meta)


def _views_of(part: pa.RecordBatch, n_meta: int) -> tuple[np.ndarray, np.ndarray]:
    texts = part.column("text").to_pylist()
    meta = meta_features([part.column(f"meta_{i}").to_pylist() for i in range(n_meta)], [len(x or "") for x in texts])
    return text_features(texts), meta


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    meta_cols: list[str] | None = None, settings: Settings | None = None,
) -> Model:
    """Fit on at most about ``labelled`` + ``unlabelled`` rows, picked by a hash of their ids."""
    settings = settings or Settings()
    meta_cols = ["lang", "source"] if meta_cols is None else meta_cols
    ship(docs.sparkSession)
    share = lambda seed: F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(id_col, F.col(label_col).cast("double").alias("label")).distinct()
    n_known, n_docs = known.count(), docs.count()
    known = known.where(share(1) < settings.labelled / max(1, n_known))
    known = known.select(F.col(id_col).alias("_id"), "label")
    ids = docs.select(id_col, text_col, *meta_cols)
    # The picked labels, about ``labelled`` rows of 16 bytes, are broadcast: no text is shuffled.
    marked = ids.join(F.broadcast(known), ids[id_col] == known["_id"], "left")
    some = marked.where(F.col("label").isNotNull() | (share(2) < settings.unlabelled / max(1, n_docs)))
    some = some.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *(F.col(c).cast("string").alias(f"meta_{i}") for i, c in enumerate(meta_cols)), "label",
                       (share(3) < settings.held_out).alias("held"))
    n_meta = len(meta_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                text, meta = _views_of(part, n_meta)
                both = [x.tobytes() for x in np.concatenate([text, meta], axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.string()), part.column("label"), part.column("held"), pa.array(both, pa.binary())],
                    ["doc_id", "label", "held", "x"],
                )

    rows = some.mapInArrow(run, "doc_id string, label double, held boolean, x binary").toArrow()
    order = np.argsort(np.array([f"{a}/{b}" for a, b in zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist())]), kind="stable") if len(rows) else []
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(rows), HASHED + SHAPE + META)[order] if len(rows) else np.zeros((0, HASHED + SHAPE + META), np.float32)
    label = np.array([np.nan if v is None else v for v in rows["label"].to_pylist()])[order] if len(rows) else np.zeros(0)
    held = np.array(rows["held"].to_pylist(), bool)[order] if len(rows) else np.zeros(0, bool)
    has = ~np.isnan(label)
    text, meta = x[:, : HASHED + SHAPE], x[:, HASHED + SHAPE :]
    return co_train(text[has], meta[has], label[has], held[has], text[~has], meta[~has], settings)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: list[str] | None = None,
    keep_at: float = 0.5,
) -> DataFrame:
    """doc_id, score, text_score, meta_score (double) and kept of every row."""
    meta_cols = ["lang", "source"] if meta_cols is None else meta_cols
    ship(docs.sparkSession)
    rows, n_meta = _viewed(docs, id_col, text_col, meta_cols), len(meta_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = [pa.array(x, pa.float64()) for x in model.scores(*_views_of(part, n_meta))]
                kept = pa.array(found[0].to_numpy() >= keep_at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found, kept], ["doc_id", "score", "text_score", "meta_score", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean")
