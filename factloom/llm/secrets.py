"""Secret scans: three base patterns, and credential-context values whose guess cost is high.

The cost of a value is the least sum, over all its segmentations, of the segments' log10 guesses. A segment is
  * a word: log10(1 + rank), and more where it has capitals or digits that stand for letters;
  * a date or a year;
  * a repeat: a block of up to BLOCKS characters, two times or more (one character: three);
  * a keyboard walk or a sequence of neighbouring code points, of three characters or more;
  * one brute-force character: log10 of its class, 10 digits, 26 small or capital letters, 33 others. A span costs their sum.
Runs have any length up to LONGEST_RUN, and the whole length of what goes on from their start. A forward dynamic program over the
value's places finds the least; its steps follow the value's length.

Words are ranked by those of the documents themselves: train() counts the words of all whole texts with Spark, outside credential
values, and keeps those whose count no more than RANKS words reach, after the fixed list of what guessers try first.

Spans are in code points, end exclusive. The method's own kind is `guess`, after the base kinds; it only adds spans.

Defined results: a null or empty text has no spans and the hash of an empty string; repeated rows give repeated rows; words of equal
count rank by code points; spans that start together stand in the order of KINDS; an empty table gives no rows; a null doc_id stays
null; extra columns are ignored. Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import slices, written

# Fixed values.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
CONTEXT = re.compile(r"""(?:passphrase|password|passwd|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth[_-]?key)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})""", re.I | re.A)
HINTS = ("passphrase", "passw", "pwd", "secret", "token", "credential", "key")
#: Words that a guesser tries first, in order.
COMMON = "password passwd admin secret login welcome letmein qwerty dragon monkey master hello shadow sunshine princess football changeme default example sample test testing user guest root demo null none true false token apikey key value string your here xxx abc foo bar baz iloveyou love you correct horse battery staple".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_SIZES = (4, 8, 9, 10)
LOOKS = str.maketrans("013457@$!", "oieastasi")

#: log10 guesses from which a credential value counts as a secret.
LEAST_COST = 10.0
RANKS, SHORTEST_WORD, LONGEST_WORD = 20_000, 3, 20
BLOCKS, LONGEST_RUN = 4, 64
WORDS = re.compile(rf"(?<![a-z])[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?![a-z])")


def _beside() -> frozenset[str]:
    """Pairs of keys that touch: in a row, and in the row below at the same place or the one before."""
    pairs = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    for upper, lower in zip(ROWS, ROWS[1:], strict=False):
        pairs |= {upper[i] + lower[j] for i in range(len(upper)) for j in (i - 1, i) if 0 <= j < len(lower)}
    return frozenset(pairs | {p[::-1] for p in pairs})


_BESIDE = _beside()


def ranked(words: list[str]) -> dict[str, int]:
    """Rank of each word: the fixed list, then the others in their order."""
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON, *words]))}


_COMMON_RANKS = ranked([])


def character_cost(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33)


def word_cost(piece: str, ranks: Mapping[str, int]) -> float:
    """Cost of a piece that is a word, as it stands or with digits and marks for letters; else infinite."""
    low, out = piece.lower(), math.inf
    for word, extra in ((low, 0.0), (low.translate(LOOKS), 0.5)):
        if rank := ranks.get(word):
            upper = sum(c.isupper() for c in piece)
            out = min(out, extra + math.log10(1 + rank) + (0.3 * min(upper, len(piece) - upper) + 0.3 if upper else 0))
    return out


def guess_cost(value: str, ranks: Mapping[str, int] = _COMMON_RANKS, enough: float = math.inf) -> float:
    """Least log10 guesses over all segmentations of value; once it is known to be at least `enough`, some number from there on."""
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    single = [character_cost(c) for c in value]

    def runs(same: list[bool]) -> list[int]:
        """Characters of the run that starts at each place, from whether a place and the next go together."""
        out = [1] * n
        for i in range(n - 2, -1, -1):
            if same[i]:
                out[i] = out[i + 1] + 1
        return out

    code = [ord(c) for c in low] + [0]
    pairs = range(max(0, n - 1))
    steps = [(runs([code[i + 1] - code[i] == d for i in pairs]), 1.2) for d in (1, -1)] + [(runs([low[i : i + 2] in _BESIDE for i in pairs]), 1.6)]
    again = [[0] * (n + 1) for _ in range(BLOCKS + 1)]  # characters from here that equal those k places on
    for k in range(1, BLOCKS + 1):
        for i in range(n - k - 1, -1, -1):
            if low[i] == low[i + k]:
                again[k][i] = again[k][i + 1] + 1

    furthest = 0
    for i in range(n):
        here = best[i]

        def reach(end: int, cost: float, here: float = here) -> None:
            nonlocal furthest
            furthest = max(furthest, end)
            if here + cost < best[end]:
                best[end] = here + cost

        if i % 8 == 7 and furthest - i < 1000 and (least := min(best[i : furthest + 1])) >= enough:
            return least  # every segmentation has a boundary from here to the furthest

        reach(i + 1, single[i])
        for size in range(SHORTEST_WORD, min(LONGEST_WORD, n - i) + 1):
            reach(i + size, word_cost(value[i : i + size], ranks))
        if "0" <= value[i] <= "3":
            for size in DATE_SIZES:
                if i + size <= n and DATE.fullmatch(value, i, i + size):
                    reach(i + size, math.log10(120 if size == 4 else 365 * 120))
        for run, base in steps:
            for size in {*range(3, min(run[i], LONGEST_RUN) + 1), run[i]} if run[i] >= 3 else ():
                reach(i + size, base + math.log10(size))
        block = 0.0
        for k in range(1, min(BLOCKS, n - i) + 1):
            block += single[i + k - 1]
            times = again[k][i] // k + 1
            for m in {*range(3 if k == 1 else 2, min(times, LONGEST_RUN // k) + 1), times} if times >= (3 if k == 1 else 2) else ():
                reach(i + k * m, block + math.log10(m))
    return best[n]


def train(docs: DataFrame, most: int = RANKS) -> dict[str, int]:
    """Ranks of the words of all texts, credential values left out; bounded by `most`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts: Counter = Counter()
                for text in part.column("text").to_pylist():
                    low = (text or "").lower()
                    if any(h in low for h in HINTS):
                        low = CONTEXT.sub(" ", low)
                    counts.update(WORDS.findall(low))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts = written(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # How many words have each count, from the top; so that the driver is sent no more than the words that it keeps.
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", above).where(F.col("above") <= most).agg(F.min("n")).first()[0]
    kept = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect() if least is not None else []
    return ranked([r.word for r in kept])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, ranks: Mapping[str, int] = _COMMON_RANKS, least: float = LEAST_COST) -> list[tuple[int, int, int]]:
    """(start, kind, end) of credential-context values that cost at least `least`."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks, least) >= least]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ranks: Mapping[str, int] | None = None, least: float = LEAST_COST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans; ranks: those of train(), or the fixed list alone."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks or _COMMON_RANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    extra = guess_spans(text or "", shared.value, least)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(extra), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + extra))))
                columns = [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(6)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
