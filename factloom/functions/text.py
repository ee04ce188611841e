"""Text functions: globs, templates, locations, identifiers, durations. All give Columns, no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that a message template may name, and their expressions.
FIELDS = {
    "fact.type": lambda: F.col("fact_type"), "fact.id": lambda: F.col("fact_id"), "fact.message": lambda: F.col("message"),
    "fact.confidence": lambda: F.format_string("%.2f", F.col("confidence")),
    "location.file": lambda: F.col("file"), "location.start_line": lambda: F.col("start_line").cast("string"), "location.end_line": lambda: F.col("end_line").cast("string"),
}


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: * stands for any text; ? for one character, but only where the pattern also has a *."""
    if "*" not in pattern:
        return f"^{re.escape(pattern)}$"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def glob(column: Column | str, pattern: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike(f"(?s){glob_regex(pattern)}") if "*" in pattern else c == pattern


def pieces(text: str) -> list[tuple[str, str | None, str | None]]:
    """A message's literal texts, each with the field or the metadata key that follows it; an unknown field is an error."""
    out, last = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", text):
        name = m[1].strip()
        if name not in FIELDS and not name.startswith("metadata."):
            raise ValueError(f"unknown field in a template: {name}")
        out.append((text[last : m.start()], name if name in FIELDS else None, None if name in FIELDS else name[9:]))
        last = m.end()
    return [*out, (text[last:], None, None)]


def template(text: str, metadata: str = "metadata") -> Column:
    """A message with {field} and {metadata.key} filled in; a missing key reads "unknown"."""
    parts = []
    for before, field, key in pieces(text):
        parts.append(F.lit(before))
        if field is not None:
            parts.append(F.coalesce(FIELDS[field](), F.lit("")))
        elif key is not None:
            parts.append(F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit("unknown")))
    return F.concat(*parts)


def location_text(file="file", start="start_line", column="start_column", end="end_line", end_column="end_column") -> Column:
    """file:start-end, with columns where they are known."""
    base = F.concat(F.col(file), F.lit(":"), F.col(start).cast("string"))
    base = F.concat(base, F.when(F.col(column).isNotNull(), F.concat(F.lit(":"), F.col(column).cast("string"))).otherwise(F.lit("")))
    base = F.concat(base, F.lit("-"), F.col(end).cast("string"))
    return F.concat(base, F.when(F.col(end_column).isNotNull(), F.concat(F.lit(":"), F.col(end_column).cast("string"))).otherwise(F.lit("")))


def number_text(column: Column) -> Column:
    """A number as text, without the fraction of a whole number."""
    return F.when(column == F.floor(column), F.floor(column).cast("string")).otherwise(column.cast("string"))


def normalized(column: Column) -> Column:
    """Lower case, without white space at both ends."""
    return F.regexp_replace(F.lower(column), r"^\s+|\s+$", "")


def cwe(column: Column) -> Column:
    """The number of a CWE-n identifier, or null."""
    n = F.regexp_extract(column, r"^CWE-(\d+)$", 1)
    return F.when(n != "", n.cast("int"))


def cve(column: Column) -> Column:
    """CVE-YYYY-NNNNNNN with the number padded to seven digits, or null."""
    year, n = F.regexp_extract(column, r"^CVE-(\d{4})-(\d{1,7})$", 1), F.regexp_extract(column, r"^CVE-(\d{4})-(\d{1,7})$", 2)
    return F.when(year != "", F.concat(F.lit("CVE-"), year, F.lit("-"), F.lpad(n, 7, "0")))


def metavariables(column: Column) -> Column:
    """Names after a $, in order."""
    return F.regexp_extract_all(column, F.lit(r"\$(\w+)"), F.lit(1))


def relative(column: Column, root: str) -> Column:
    return F.when(column.startswith(root.rstrip("/") + "/"), F.substring(column, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(column)


DURATION = r"^\s*(\d+)\s*(ms|s|m|h)\s*$"
#: Milliseconds of a unit. Fixed values.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def duration_ms(text: Column) -> Column:
    """Milliseconds of durations such as 500ms, 30s, 5m or 2h; null for any other text."""
    number = F.regexp_extract(text, DURATION, 1)
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(text.rlike(DURATION), number.cast("long") * F.element_at(scale, F.regexp_extract(text, DURATION, 2)))


def parse_duration(text: str) -> int:
    """Milliseconds of a duration such as 500ms, 30s, 5m or 2h."""
    m = re.fullmatch(DURATION[1:-1], text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]
