"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other on unlabelled pages.

The text view reads the text: which of the most telling words it has, and its figures (marks, digits, capitals, repeats, the share of
each ASCII mark). The metadata view reads the page's record alone: source, language and n_chars. Both are logistic regressions, for two
heads: good quality, and toxic. In each of ROUNDS rounds a view gives the other its most confident pseudo-labels of a pool of unlabelled
documents. Last, each view is calibrated on labelled documents that it was not fitted on, and the calibrated log-odds are added up, the
common prior taken off once: a view that tells little gets a slope near 0. A document is kept if it is more likely good than not, and
less likely toxic than not.

Fitting uses bounded samples, picked by hash: about LABELLED labelled documents and UNLABELLED others, written once, and VOCABULARY words
a head, counted over their whole texts by Spark. Scoring reads every whole text.

Defined results: a null or empty text is rejected with score 0; without labels of both kinds a head says nothing (good: 1, toxic: 0);
several labels of one document are averaged, labels without doc_id ignored; of rows that repeat a labelled doc_id one is fitted on (the
one with the least hash of its text), and equal unlabelled rows are one in the pool; equal probabilities keep (good) and reject (toxic);
repeated rows are scored each; an empty table gives no rows; score() ignores extra columns and accepted() keeps them; a missing source,
language or n_chars is a value of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import slices, text_bytes, written
from factloom.llm.words import MARKS, words

LABELLED, UNLABELLED, VOCABULARY = 5000, 4000, 600
ROUNDS, CONFIDENT, SHARE = 4, 0.95, 0.05
HEADS = ("good", "toxic")
_SOURCES = 256
_UPPER, _DIGIT, _LINE = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = _LINE[10] = True
_EACH_MARK = [x for x in range(33, 127) if not chr(x).isalnum()]
_MARK_PLACE = np.full(256, -1)
_MARK_PLACE[_EACH_MARK] = np.arange(len(_EACH_MARK))
INPUTS = ("text", "source", "lang", "n_chars")


def _text_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct words."""
    _, _, text, h = words(*text_bytes(part.column("text")), MARKS)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[keep], h[keep]


def _figures(part: pa.RecordBatch) -> np.ndarray:
    """Figures of the texts, each with its square."""
    raw, offsets = text_bytes(part.column("text"))
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets])
    _, _, text, h = words(raw, offsets)
    per = np.bincount(text, minlength=n)
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=n)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[twin], minlength=n)
    per_ = np.maximum(per, 1)
    lines = count(_LINE) + 1
    figures = [np.log(size) / 10, np.log(lines) / 5, np.minimum(size / lines, 2000) / 1000, 5 * count(_DIGIT) / size, 3 * count(_UPPER) / size, distinct / per_ - 1, 3 * repeats / per_, np.minimum(size / per_, 40) / 10]
    at = np.where(_MARK_PLACE[raw] >= 0)[0]
    row = np.searchsorted(offsets, at, "right") - 1
    each = np.bincount(row * len(_EACH_MARK) + _MARK_PLACE[raw[at]], minlength=n * len(_EACH_MARK)).reshape(n, -1) / size[:, None]
    figures += [5 * each.sum(1), *(20 * each).T]
    return np.concatenate([np.stack([f, np.minimum(f, 1) ** 2], 1) for f in figures], 1).astype(np.float32)


def _metadata(part: pa.RecordBatch) -> np.ndarray:
    """One-hot source and language, and the size that the record gives."""
    n = part.num_rows
    chars = np.asarray(part.column("n_chars").cast(pa.float64()).fill_null(-1.0))
    known = chars >= 0
    size = np.log1p(np.maximum(chars, 0)) / 10
    hashed = np.zeros((n, _SOURCES + 16))
    for column, width, base in (("source", _SOURCES, 0), ("lang", 16, _SOURCES)):
        codes = [hash_text(x) % width for x in part.column(column).to_pylist()]
        hashed[np.arange(n), base + np.array(codes, np.int64)] = 0.3
    return np.concatenate([np.stack([known, size, size**2], 1), hashed], 1).astype(np.float32)


def hash_text(x: str | None) -> int:
    return 0 if x is None else sum((k + 1) * b for k, b in enumerate(x.encode())) * 2654435761 % (1 << 32) >> 7


class Logistic:
    """Logistic regression with balanced classes, by accelerated gradient steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> Logistic:
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32) / len(y)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        mw, mb, vw, vb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
        for t in range(1, steps + 1):
            e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
            gw, gb = x.T @ e + decay * w, float(e.sum())
            mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
            a, c = 0.1 / (1 - 0.9**t), 1 - 0.99**t
            w, b = w - a * mw / (np.sqrt(vw / c) + 1e-8), b - a * mb / (np.sqrt(vb / c) + 1e-8)
        self.w, self.b, self.slope, self.shift = w, b, 1.0, 0.0
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Slope and shift of the log-odds on rows not fitted on."""
        z, a, b = np.clip(self.raw(x), -30, 30), 1.0, 0.0
        t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):
            e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
            a, b = a - 0.05 * float((e * z).mean()), b - 0.3 * float(e.mean())
        self.slope, self.shift = max(a, 0.0), b
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(self.raw(x), -30, 30) + self.shift


def _below(n: int, size: int, mark: str) -> Column:
    """Whether the hash `mark` is in the share that leaves about `size` of n rows."""
    return F.pmod(mark, F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(1, n)))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model of bounded size, or None without labels."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("good"), F.avg("toxic").alias("toxic"), F.xxhash64("doc_id").alias("label"))
    marked = F.broadcast(known.where(_below(known.count(), LABELLED, "label")))  # about LABELLED rows
    rows = docs.select("doc_id", *INPUTS, F.xxhash64("doc_id", "text").alias("mark")).join(marked, "doc_id", "left")
    chosen = rows.where(F.col("label").isNotNull() | _below(docs.count(), UNLABELLED, "mark"))
    row = F.struct("mark", "doc_id", *INPUTS, *HEADS, "label")
    sample = chosen.groupBy(F.coalesce("label", "mark").alias("key"), F.col("label").isNull().alias("pool")).agg(F.min(row).alias("row"))
    sample = written(sample.select("row.*"), "sample")
    seen = sample.where(F.col("label").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, h = _text_words(part)
                bad = [np.asarray(part.column(c).fill_null(0.0)).astype(float)[text] > 0.5 for c in HEADS]
                u, at = np.unique(h, return_inverse=True)
                columns = [np.bincount(at, minlength=len(u)), *(np.bincount(at, b, len(u)).astype(np.int64) for b in bad)]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, columns)], ["word", "n", *HEADS])

    totals = seen.agg(F.count("*"), F.sum((F.col("good") > 0.5).cast("int")), F.sum((F.col("toxic") > 0.5).cast("int"))).first()
    if not totals[0]:
        return None
    counts = written(seen.select("text", *HEADS).mapInArrow(count, "word long, n long, good long, toxic long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]), "counts")
    vocabulary = {}
    for k, head in enumerate(HEADS):
        yes, no = totals[k + 1] or 0, totals[0] - (totals[k + 1] or 0)
        inside, outside = F.col(head), F.col("n") - F.col(head)
        ratio = F.abs(F.log((inside + 0.5) / (yes + 1.0)) - F.log((outside + 0.5) / (no + 1.0)))
        best = counts.where(F.col("n") >= 3).withColumn("rank", ratio * F.sqrt("n")).orderBy(F.desc("rank"), "word").limit(VOCABULARY)
        vocabulary[head] = np.sort(np.array([r.word for r in best.select("word").collect()], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                views = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (_figures(part), _metadata(part))]
                for head in HEADS:
                    seen_words = pa.array([r.tobytes() for r in _content(part, vocabulary[head]).astype(np.uint8)], pa.binary())
                    columns = [pa.array([head] * part.num_rows), part.column("mark"), part.column(head), seen_words, *views]
                    yield pa.RecordBatch.from_arrays(columns, ["head", "mark", "y", "words", "figures", "meta"])

    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("mark")
        stacked = lambda c, t: np.stack([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]).astype(np.float32)
        content = np.concatenate([stacked("words", np.uint8), stacked("figures", np.float32)], 1)
        made = co_trained((content, stacked("meta", np.float32)), rows.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([pickle.dumps(made)], pa.binary())], ["head", "model"])

    # The driver gets the fitted models alone: the sample with its features is a task's, for each head.
    bounded = sample.mapInArrow(features, "head string, mark long, y double, words binary, figures binary, meta binary")
    models = bounded.groupBy("head").applyInArrow(fit, "head string, model binary").collect()
    return {"vocabulary": vocabulary, **{r.head: pickle.loads(bytes(r.model)) for r in models}}


def co_trained(views: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> dict | None:
    """Both views' classifiers and the prior log-odds; y: NaN where there is no label."""
    labelled, pool = np.flatnonzero(~np.isnan(y)), np.flatnonzero(np.isnan(y))
    target = (y > 0.5).astype(np.float32)
    held = labelled[::4]
    fitted = np.setdiff1d(labelled, held)
    if min(target[held].sum(), len(held) - target[held].sum(), target[fitted].sum(), len(fitted) - target[fitted].sum()) < 2:
        return None
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view was given by the other
    for turn in range(ROUNDS + 1):
        models = []
        for view, extra in zip(views, given, strict=True):
            rows = np.concatenate([fitted, np.array(list(extra), np.int64)])
            values = np.concatenate([target[fitted], np.array(list(extra.values()), np.float32)])
            models.append(Logistic().fit(view[rows], values).calibrate(view[held], target[held]))
        if turn == ROUNDS or not len(pool):
            break
        most = max(1, int(SHARE * len(pool)))
        for k, model in enumerate(models):
            p = 1 / (1 + np.exp(-model.log_odds(views[k][pool])))
            for value, confidence in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-confidence, kind="stable")[:most]
                given[1 - k].update({int(pool[i]): value for i in best if confidence[i] >= CONFIDENT})
    share = np.clip(target[labelled].mean(), 1e-3, 1 - 1e-3)
    return {"models": models, "prior": float(np.log(share / (1 - share)))}


def _content(part: pa.RecordBatch, vocabulary: np.ndarray) -> np.ndarray:
    text, h = _text_words(part)
    out = np.zeros((part.num_rows, max(1, len(vocabulary))), np.float32)
    if len(vocabulary) and len(h):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        found = vocabulary[at] == h
        out[text[found], at[found]] = 1
    return out


def _probabilities(part: pa.RecordBatch, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    out = []
    figures, record = (_figures(part), _metadata(part)) if model else (None, None)
    for head, otherwise in zip(HEADS, (1.0, 0.0), strict=True):
        if model is None or model[head] is None:
            out.append(np.full(part.num_rows, otherwise))
            continue
        content, meta = model[head]["models"]
        words_and_figures = np.concatenate([_content(part, model["vocabulary"][head]), figures], 1)
        z = content.log_odds(words_and_figures) + meta.log_odds(record) - model[head]["prior"]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    empty = np.asarray(pc.binary_length(part.column("text")).fill_null(0)) == 0
    out[0] = np.where(empty, 0.0, out[0])
    return out[0], out[1]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, p_good, p_toxic, score, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                good, toxic = _probabilities(part, shared.value)
                columns = [part.column("doc_id").cast(pa.int64()), *map(pa.array, (good, toxic, good * (1 - toxic), (good >= 0.5) & (toxic < 0.5)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "p_good", "p_toxic", "score", "keep"])

    return docs.select("doc_id", *INPUTS).mapInArrow(run, "doc_id long, p_good double, p_toxic double, score double, keep boolean")


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents that are kept, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                good, toxic = _probabilities(part, shared.value)
                yield part.filter(pa.array((good >= 0.5) & (toxic < 0.5)))

    return docs.mapInArrow(run, docs.schema)
