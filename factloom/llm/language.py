"""Language identification by word-first backoff.

A known word gives its log frequency in each language. An unseen word gives, from each position, the log frequency of the longest
known character n-gram there, of LONGEST characters at first and then shorter ones. A text's evidence is summed over its words.

The tables are counted with Spark on a sample of labelled rows: of each language about LANG_DOCS documents (all, where there are
fewer), picked by hash of doc_id and text, so that a rare language is learned as well at every size; whole texts are counted. The model
has a bounded size: the WORDS most frequent words and GRAMS n-grams a language, and ENTRIES of both in all where there are very many
languages. Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never counted.

Defined results: `und` with score 0 for a null text, one without a letter, or where no language was learned; equal evidence goes to
the first language in code-point order; a row without doc_id is not held out; equal rows count once in the sample; repeated rows give
repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import slices, written

LANG_DOCS, WORDS, GRAMS, ENTRIES, LONGEST = 2500, 20_000, 20_000, 800_000, 4
#: Words whose evidence counts in full for the score: it is a probability, not a count of words.
EVIDENCE = 20
MEMO = 400_000
#: Languages whose shares are broadcast, once counted; more are joined by a shuffle.
BROADCAST_LANGS = 100_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


def count_grams(rows: DataFrame, most: int) -> DataFrame:
    """lang, kind (w or g), gram, n, total of the most frequent words and n-grams of each language, `most` of each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words: dict[str, Counter] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                out = []
                for lang, counts in words.items():
                    grams: Counter = Counter()
                    for w, n in counts.items():
                        out.append((lang, "w", w, n))
                        for g in _grams(w):
                            grams[g] += n
                    out += [(lang, "g", g, n) for g, n in grams.items()]
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "kind", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= F.least(F.when(F.col("kind") == "w", WORDS).otherwise(GRAMS), F.lit(most)))
    return top.join(totals, ["lang", "kind"]).select("lang", "kind", "gram", "n", "total")


class Model:
    """Log frequencies of words and n-grams by language. Rows of numbers: a word's or an n-gram's place is a row of `low`'s width."""

    def __init__(self, rows: list[tuple[str, str, str, int, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        column = {x: k for k, x in enumerate(self.langs)}
        floor = {(r[0], r[1]): np.log(0.5 / r[4]) for r in rows}
        tables: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        for kind in ("w", "g"):
            own = [r for r in rows if r[1] == kind]
            at: dict[str, int] = {}
            place = [at.setdefault(r[2], len(at)) for r in own]
            values = np.tile(np.array([floor.get((x, kind), -20.0) for x in self.langs]), (len(at), 1))
            values[place, [column[r[0]] for r in own]] = np.log(np.array([r[3] for r in own], float) / np.array([r[4] for r in own], float))
            tables[kind] = at, values
        (self.words, self.word_values), (grams, self.gram_values) = tables["w"], tables["g"]
        self._grow(grams)
        self.memo: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.langs)))

    def _grow(self, grams: dict[str, int]) -> None:
        """The n-grams as a tree: sorted keys (node << 21 | code point), the child that each leads to, and the n-gram of each node (-1: none)."""
        nodes: dict[str, int] = {"": 0}
        keys: list[int] = []
        for g in grams:
            for n in range(1, len(g) + 1):
                if g[:n] not in nodes:
                    keys.append(nodes[g[: n - 1]] << 21 | ord(g[n - 1]))
                    nodes[g[:n]] = len(nodes)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.child = np.array(keys, np.int64)[order], order + 1
        self.gram = np.full(len(nodes), -1)
        for g, k in grams.items():
            self.gram[nodes[g]] = k

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """The longest n-gram that starts at each place of a run of code points, -1 for none; the runs are parted by zeros."""
        best = np.full(len(codes), -1)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for n in range(LONGEST):
            inside = at + n < len(codes)
            at, node = at[inside], node[inside]
            key = node << 21 | codes[at + n]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[k] == key
            at, node = at[met], self.child[k[met]]
            found = self.gram[node]
            best[at[found >= 0]] = found[found >= 0]
        return best

    def evidence(self, new: list[str]) -> np.ndarray:
        """Log frequencies by language of each word, with their mean taken off."""
        out = np.zeros((len(new), len(self.langs)))
        place = np.fromiter((self.words.get(w, -1) for w in new), np.int64, len(new))
        out[place >= 0] = self.word_values[place[place >= 0]]
        unseen = np.flatnonzero(place < 0)
        if len(unseen) and len(self.keys):
            codes = np.frombuffer("".join(f"<{new[k]}>\0" for k in unseen).encode("utf-32-le"), np.uint32).astype(np.int64)
            best = self.longest(codes)
            of = np.cumsum(codes == 0)[best >= 0]
            best = best[best >= 0]
            n = np.bincount(of, minlength=len(unseen))
            for k in range(len(self.langs)):
                out[unseen, k] = np.bincount(of, self.gram_values[best, k], len(unseen)) / np.maximum(n, 1)
        return out - out.mean(axis=1, keepdims=True)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Row of `known` of each word."""
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set(words)
        if new:
            first, last = len(self.memo), len(self.memo) + len(new)
            if last > len(self.known):
                self.known = np.concatenate([self.known[:first], np.zeros((2 * last - first, len(self.langs)))])
            self.known[first:last] = self.evidence(list(new))
            self.memo.update(zip(new, range(first, last), strict=True))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


def train(docs: DataFrame) -> list[tuple[str, str, str, int, int]]:
    """Rows of the tables; bounded by WORDS, GRAMS and ENTRIES."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    share = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), LANG_DOCS / F.count("*")).alias("share")), "langs")
    n_langs = share.count()
    steps = 1 << 30
    picked = rows.join(F.broadcast(share) if n_langs <= BROADCAST_LANGS else share, "lang").where(F.pmod("mark", F.lit(steps)) < F.col("share") * steps).dropDuplicates(["lang", "mark"])
    return [tuple(r) for r in count_grams(picked, ENTRIES // 2 // max(1, n_langs)).collect()]


_models: dict[str, Model] = {}


def predict(docs: DataFrame, rows: list[tuple[str, str, str, int, int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex  # a worker process opens the model once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model(shared.value)
        model = _models[name]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                split = [WORD.findall((t or "").lower()) for t in part.column("text").to_pylist()]
                split = [w if w and (w[0].isalpha() or any(c.isalpha() for x in w for c in x)) else [] for w in split]
                flat = [w for words in split for w in words]
                preds, scores = [UNKNOWN] * len(split), np.zeros(len(split))
                if model.langs and flat:
                    at = model.look_up(flat)
                    of = np.repeat(np.arange(len(split)), [len(w) for w in split])
                    n = np.bincount(of, minlength=len(split))
                    total = np.stack([np.bincount(of, model.known[at, k], len(split)) for k in range(len(model.langs))], axis=1)
                    mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
                    soft = np.exp(mean - mean.max(axis=1, keepdims=True))
                    soft /= soft.sum(axis=1, keepdims=True)
                    for k in np.flatnonzero(n):
                        best = int(soft[k].argmax())
                        preds[k], scores[k] = model.langs[best], min(1.0, float(soft[k, best]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(preds), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
