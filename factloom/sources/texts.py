"""Facts from source texts: lines, patterns and rules by language; and readers and writers of fact files and rules."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.severity import FROM_PATTERN_RULE, mapped
from factloom.functions.text import parse_duration

#: Languages by file extension. Fixed values.
EXTENSIONS = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "c": "c", "cpp": "cpp", "rb": "ruby", "php": "php"}


def lines(texts: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, line (from 1), text of every line."""
    split = texts.select(key, *keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    return split.select(key, *keep, (F.col("at") + 1).alias("line"), "text")


def marked_lines(rows: DataFrame, marker: str = "TODO", key: str = "doc_id") -> DataFrame:
    """A minor smell for each line with the marker."""
    return rows.where(F.col("text").contains(marker)).select(key, "line", F.lit("CodeSmell").alias("fact_type"), F.lit("Minor").alias("severity"), F.lit(0.8).alias("confidence"))


def language(path: Column) -> Column:
    return mapped(F.regexp_extract(path, r"\.([^./]+)$", 1), EXTENSIONS, "unknown")


def pattern_facts(rows: DataFrame, patterns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches of patterns (rule, language, pattern, category, level) in lines of their language. The rules are few and counted by the
    caller; lines meet them by language."""
    met = rows.join(patterns, rows["lang"] == patterns["language"]).where(F.col("text").contains(F.col("pattern")))
    smell = F.col("category").isin("security", "vulnerability")
    return met.select(key, "line", "rule", F.when(smell, "Vulnerability").otherwise("CodeSmell").alias("fact_type"), mapped("level", FROM_PATTERN_RULE, "Minor").alias("severity"), F.when(smell, 0.9).otherwise(0.8).alias("confidence"))


def unmatched(rows: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """Texts in which no line has the pattern."""
    return rows.groupBy(key).agg(F.count_if(F.col("text").contains(pattern)).alias("n")).where(F.col("n") == 0).select(key)


def counts(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Lines that match each regular expression, in one pass."""
    return rows.agg(F.count("*").alias("lines"), *[F.count_if(F.col("text").rlike(p)).alias(name) for name, p in patterns.items()])


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.json(path)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fact files: an array, or an object with facts or findings; an unknown ending is an error."""
    if not path.endswith((".json", ".yaml", ".yml", ".parquet")):
        return spark.read.schema(schema).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".json"):
        wrapped = spark.read.schema(f"facts ARRAY<STRUCT<{_struct(schema)}>>, findings ARRAY<STRUCT<{_struct(schema)}>>, {schema}").option("multiLine", True).json(path)
        inner = F.coalesce("facts", "findings")
        own = F.array(F.struct(*[F.col(c.split()[0]) for c in schema.split(", ")]))
        return wrapped.select(F.inline(F.when(inner.isNotNull(), inner).otherwise(own)))
    names = [c.split()[0] for c in schema.split(", ")]

    def parsed(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in files:
            for content in batch["content"]:
                held = yaml.safe_load(content)
                rows = held if isinstance(held, list) else (held or {}).get("facts", (held or {}).get("findings", []))
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, schema)


def _struct(schema: str) -> str:
    return ", ".join("{}: {}".format(*c.split()) for c in schema.split(", "))


def formatted(df: DataFrame, kind: str = "json") -> DataFrame:
    """line: each row as JSON, or as name=value pairs."""
    if kind == "json":
        return df.select(F.to_json(F.struct("*")).alias("line"))
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]).alias("line"))


def load_config(own: str, shared: str = "") -> dict[str, dict]:
    """Extractors of a TOML text by name, laid over a shared one; timeouts in milliseconds."""
    out: dict[str, dict] = {}
    for text in (shared, own):
        for entry in tomllib.loads(text).get("extractors", []):
            if not entry.get("name"):
                raise ValueError("an extractor has no name")
            entry = dict(entry)
            if "timeout" in entry:
                entry["timeout_ms"] = parse_duration(entry.pop("timeout"))
            out[entry["name"]] = out.get(entry["name"], {}) | entry
    return out


def load_rules(text: str) -> list[dict]:
    """Rules of a YAML (or JSON) text, checked: id, language, pattern and a known severity."""
    try:
        held = json.loads(text)
    except ValueError:
        import yaml

        held = yaml.safe_load(text)
    rules = held.get("rules", []) if isinstance(held, dict) else held
    for r in rules:
        missing = [k for k in ("id", "language", "pattern") if not r.get(k)]
        if missing:
            raise ValueError(f"rule without {', '.join(missing)}")
        if r.get("severity", "info") not in ("error", "warning", "info"):
            raise ValueError(f"rule {r['id']}: unknown severity")
        re.compile(re.escape(r["pattern"]))
    return rules


def translate_rule(rule: dict) -> dict:
    """A rule of the widespread pattern format as one of ours: one pattern or several, languages, severity."""
    patterns = [rule["pattern"]] if "pattern" in rule else [p["pattern"] for p in rule.get("patterns", []) if "pattern" in p]
    names = {"ERROR": "error", "WARNING": "warning", "INFO": "info"}
    return {"id": rule["id"], "language": rule.get("languages", ["generic"])[0], "languages": rule.get("languages", []), "pattern": patterns[0] if patterns else "", "patterns": patterns, "severity": names.get(rule.get("severity", "INFO"), "info"), "message": rule.get("message", "")}


#: The widespread rule format, as far as it is translated.
FOREIGN = "id STRING, pattern STRING, patterns ARRAY<STRUCT<pattern: STRING>>, severity STRING, languages ARRAY<STRING>, message STRING"


def translated(df: DataFrame, column: str) -> DataFrame:
    """id, language, languages, pattern, patterns, severity, message of rules of the widespread format, held as JSON texts in a column."""
    r = df.select(F.from_json(column, FOREIGN).alias("r")).select("r.*")
    several = F.transform(F.coalesce("patterns", F.array()), lambda p: p["pattern"])
    patterns = F.when(F.col("pattern").isNotNull(), F.array("pattern")).otherwise(F.array_compact(several))
    severity = F.when(F.col("severity").isin("ERROR", "WARNING", "INFO"), F.lower("severity")).otherwise("info")
    first = F.coalesce(F.get(patterns, F.lit(0)), F.lit(""))
    return r.select("id", F.coalesce(F.get("languages", F.lit(0)), F.lit("generic")).alias("language"), "languages", first.alias("pattern"), patterns.alias("patterns"), severity.alias("severity"), F.coalesce("message", F.lit("")).alias("message"))
