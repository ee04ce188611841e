"""Many patterns with metavariables, found in texts in one pass over each text.

A pattern is a row of tokens: words, signs, and metavariables such as $X. A metavariable stands for one token, and for the same one
wherever it is repeated; $_ stands for any token. A pattern is met at every place where the text's tokens are equal to it: places may
overlap, and white space, line ends included, separates tokens and does nothing else.

The longest stretch of a pattern without metavariables is its anchor. All anchors go into one Aho-Corasick automaton, which each task
builds from the patterns; the automaton reads each text once, however many patterns there are, and only where an anchor ends are a
pattern's other tokens compared. Texts never leave their partition: no shuffle, no join of lines with rules.

Patterns are read by the driver, at most PASS at a time; a larger table of patterns takes a pass over the texts for each PASS of them.

Defined results: a null or empty text has no places; a pattern without a word or sign of its own is an error, as is a repeated rule
name; a pattern with a null language is sought in all texts, the others in texts of that language; an empty table of patterns or texts
gives no rows. Memory follows the longest text and its tokens; places are handed on in batches of BATCH.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.severity import FROM_PATTERN_RULE, mapped

PASS = 50_000
BATCH = 20_000
#: A run of ASCII letters, digits, underscores and characters beyond ASCII, or one ASCII sign.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]"
_TOKENS, _PARTS = re.compile(TOKEN), re.compile(r"\$(?:[A-Z][A-Z0-9_]*|_)|" + TOKEN)
_VARIABLE = re.compile(r"\$(?:[A-Z][A-Z0-9_]*|_)")
_END = "\x1f"  # no token holds it


def _parsed(pattern: str) -> list[tuple[str | None, str]]:
    """(metavariable, "") or (None, token) of each part of a pattern."""
    return [(p[1:], "") if _VARIABLE.fullmatch(p) else (None, p) for p in _PARTS.findall(pattern)]


def _anchor(parts: list[tuple[str | None, str]]) -> tuple[int, str]:
    """The longest stretch of tokens, as its place in the pattern and the text that the automaton looks for."""
    runs, own = [], []
    for at, (variable, token) in enumerate([*parts, ("", "")]):
        if variable is None:
            own.append(token)
        elif own:
            runs.append((at - len(own), _END + _END.join(own) + _END))
            own = []
    if not runs:
        raise ValueError("a pattern needs a word or sign of its own")
    return max(runs, key=lambda r: (len(r[1]), -r[0]))


def _bound(parts: list[tuple[str | None, str]], tokens: list[str], start: int) -> dict[str, str] | None:
    """What the metavariables stand for if the pattern is met at a place, else None."""
    if start < 0 or start + len(parts) > len(tokens):
        return None
    found: dict[str, str] = {}
    for (variable, token), here in zip(parts, tokens[start : start + len(parts)]):
        if variable is None:
            if token != here:
                return None
        elif variable != "_" and found.setdefault(variable, here) != here:
            return None
    return found


def _finder(rules: list[tuple[str, str | None, str]], key: str, kind: pa.DataType):
    schema = pa.schema([pa.field(key, kind), pa.field("rule", pa.string()), pa.field("line", pa.int64()), pa.field("start", pa.int64()), pa.field("bound", pa.map_(pa.string(), pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        patterns = [(name, language, _parsed(pattern)) for name, language, pattern in rules]
        by_anchor: dict[str, list[tuple[int, int]]] = {}
        for nth, (_, _, parts) in enumerate(patterns):
            at, anchor = _anchor(parts)
            by_anchor.setdefault(anchor, []).append((nth, at))
        automaton = ahocorasick.Automaton()
        for anchor, users in by_anchor.items():
            automaton.add_word(anchor, (len(anchor), users))
        automaton.make_automaton()
        for batch in batches:
            rows: list[tuple[int, str, int, int, list]] = []
            made = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], schema.field(k).type) for k in range(1, 5)]], schema=schema)  # noqa: E731, B023
            for nth_row, (text, language) in enumerate(zip(batch.column(1), batch.column(2))):
                text, language = text.as_py() or "", language.as_py()
                tokens, places = [], []
                for m in _TOKENS.finditer(text):
                    tokens.append(m.group())
                    places.append(m.start())
                begins, length = [], 0
                for t in tokens:
                    begins.append(length)
                    length += len(t) + 1
                ends = [m.start() for m in re.finditer("\n", text)]
                for end, (size, users) in automaton.iter(_END + _END.join(tokens) + _END):
                    at = bisect_right(begins, end - size + 1) - 1
                    for nth, offset in users:
                        name, wanted, parts = patterns[nth]
                        if wanted is not None and wanted != language:
                            continue
                        bound = _bound(parts, tokens, at - offset)
                        if bound is not None:
                            rows.append((nth_row, name, bisect_right(ends, places[at - offset]) + 1, at - offset, sorted(bound.items())))
                    if len(rows) >= BATCH:
                        yield made()
                        rows.clear()
            if rows:
                yield made()

    return find


def places(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", language: str = "lang") -> DataFrame:
    """key, rule, line and start (of the first token, lines from 1, tokens of the text from 0), bound (metavariable to token): a row for
    each place of each of the patterns (rule, language, pattern) in texts (key, text, and the column that names the language)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = texts.sparkSession
    kept = patterns.select("rule", "language", "pattern")
    count = kept.count()
    if kept.select("rule").distinct().count() != count:
        raise ValueError("a rule has two patterns")
    passes = max(1, -(-count // PASS))
    own = texts.select(key, F.col("text").alias("text"), F.col(language).alias("language"))
    kind = own.schema[key].dataType
    out = spark.createDataFrame([], f"{key} {kind.simpleString()}, rule string, line long, start long, bound map<string, string>")
    for nth in range(passes):
        part = kept if passes == 1 else kept.where(F.pmod(F.xxhash64("rule"), F.lit(passes)) == nth)
        rules = [(r.rule, r.language, r.pattern) for r in part.collect()]
        for _, _, pattern in rules:
            _anchor(_parsed(pattern or ""))  # errors before the job
        if rules:
            out = out.union(own.mapInArrow(_finder(rules, key, to_arrow_type(kind)), out.schema))
    return out


def _filled(template: Column, bound: Column) -> Column:
    """A message with its metavariables replaced, longer names first."""
    names = F.reverse(F.array_sort(F.map_keys(bound)))
    return F.aggregate(names, template, lambda text, name: F.replace(text, F.concat(F.lit("$"), name), bound[name]))


def facts(found: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Places as facts: the type by the rule's category, the severity by its level, its message with what the metavariables stand for.
    rules: rule (no two alike), category, level, message."""
    smell = F.col("category").isin("security", "vulnerability")
    return found.join(rules.select("rule", "category", "level", "message"), "rule").select(
        key, "rule", "line", "start", F.when(smell, "Vulnerability").otherwise("CodeSmell").alias("fact_type"),
        mapped("level", FROM_PATTERN_RULE, "Minor").alias("severity"), F.when(smell, 0.9).otherwise(0.8).alias("confidence"), _filled(F.col("message"), F.col("bound")).alias("message"),
    )
