"""Severity vocabularies. All are fixed values; each is turned into one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IR_RANK = {"Info": 0, "Minor": 1, "Major": 2, "Critical": 3, "Blocker": 4}
SERVER_RANK = {"Info": 1, "Minor": 2, "Major": 3, "Critical": 4}
EXIT_CODE = {"Info": 0, "Minor": 0, "Major": 1, "Critical": 2, "Blocker": 3}
FROM_RULES = {"Critical": "Critical", "High": "Major", "Medium": "Minor", "Low": "Info", "Info": "Info"}
FROM_REPORT_LEVEL = {"error": "Critical", "warning": "Major", "note": "Minor", "none": "Minor"}
FROM_LINTER = {"error": "Critical", "warning": "Major", "info": "Minor"}
FROM_PATTERN_RULE = {"error": "Critical", "warning": "Major", "info": "Info"}


def mapped(column: Column | str, table: dict, otherwise=None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def sql_case(column: str, table: dict, otherwise: str = "NULL") -> str:
    """The same expression as SQL text."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {column} = {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def published(column: Column | str) -> Column:
    """The server's vocabulary has no Blocker: it is published as Critical."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == "Blocker", "Critical").otherwise(c)


def coverage_band(percent: Column) -> Column:
    return F.when(percent < 50, "low").when(percent <= 80, "acceptable").otherwise("excellent")


def complexity_level(score: Column) -> Column:
    return F.when(score < 20, "Low").when(score < 50, "Medium").when(score < 80, "High").otherwise("Critical")
