"""Tool reports as facts: static-analysis reports (two mappings), linter output, coverage XML. All are projections of nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.severity import FROM_LINTER, FROM_REPORT_LEVEL, IR_RANK, mapped
from factloom.functions.text import relative

REPORT = """version STRING, runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<name: STRING, version: STRING>>, results: ARRAY<STRUCT<
  ruleId: STRING, level: STRING, message: STRUCT<text: STRING>,
  locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT, startColumn: INT, endLine: INT, endColumn: INT>>>>,
  properties: STRUCT<`security-severity`: VARIANT, cwe: ARRAY<STRING>, tags: ARRAY<STRING>, owasp: STRING, cvss: DOUBLE>>>>>"""
LINTER = "filename STRING, code STRING, message STRING, severity STRING, line INT, column INT, endLine INT, endColumn INT"


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Report files under a path, or files with a report a line; the schema is given, so nothing is read twice to infer it."""
    if lines:
        return spark.read.schema(REPORT).json(path)
    return spark.read.schema(REPORT).option("multiLine", True).option("pathGlobFilter", "*{.sarif,sarif*.json}").json(path)


def read_linter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINTER).option("multiLine", True).json(path)


def results(reports: DataFrame) -> DataFrame:
    """A row a result: tool, tool_version, rule, level (warning where it is missing), text, place (the first), props."""
    runs = reports.select(F.explode("runs").alias("run"))
    rows = runs.select(F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.version").alias("tool_version"), F.explode("run.results").alias("r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return rows.select("tool", "tool_version", F.coalesce("r.ruleId", F.lit("unknown")).alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), F.coalesce("r.message.text", F.lit("")).alias("text"), place.alias("place"), F.col("r.properties").alias("props"))


def location(place: Column) -> list[Column]:
    """file, start_line, start_column, end_line, end_column; without a region line 1, and column 0 is none."""
    region = place["region"]
    start = F.greatest(F.coalesce(region["startLine"], F.lit(1)), F.lit(1))
    none = lambda c: F.when(c > 0, c)
    return [F.coalesce(place["artifactLocation"]["uri"], F.lit("unknown")).alias("file"), start.alias("start_line"), none(region["startColumn"]).alias("start_column"), F.greatest(F.coalesce(region["endLine"], start), start).alias("end_line"), none(region["endColumn"]).alias("end_column")]


def is_security(rule: Column, props: Column) -> Column:
    """A security severity, a telling tag, or a telling rule id (also any that starts with s)."""
    low = F.lower(rule)
    tagged = F.exists(F.coalesce(props["tags"], F.array().cast("array<string>")), lambda t: F.lower(t).contains("security") | F.lower(t).contains("vulnerability"))
    named = low.contains("security") | low.contains("vulnerability") | low.contains("cwe") | low.startswith("s")
    return props["security-severity"].isNotNull() | F.coalesce(tagged, F.lit(False)) | named


def cwe_of(props: Column) -> Column:
    numbers = F.transform(F.coalesce(props["cwe"], F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"^(?:CWE-)?(\d+)$", 1))
    first = F.get(F.filter(numbers, lambda x: x != ""), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("CWE-"), first))


def report_facts(reports: DataFrame, least: str = "Info", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Facts of all results; excluded: parts of rule ids to leave out; least: the lowest severity to keep."""
    rows = results(reports).withColumn("severity", mapped("level", FROM_REPORT_LEVEL, "Major"))
    rows = rows.where(mapped("severity", IR_RANK) >= IR_RANK[least])
    for part in excluded:
        rows = rows.where(~F.col("rule").contains(part))
    given = F.col("props.security-severity")  # a number counts, a text does not
    number = F.when(F.schema_of_variant(given) != "STRING", F.try_variant_get(given, "$", "double"))
    confidence = F.when(number.isNull(), 0.5).otherwise(F.least(F.greatest(number / 10, F.lit(0.0)), F.lit(1.0)))
    return rows.select(F.when(is_security(F.col("rule"), F.col("props")), "Vulnerability").otherwise("CodeSmell").alias("fact_type"), "rule", "severity", F.col("text").alias("message"), cwe_of(F.col("props")).alias("cwe_id"), F.col("props.owasp").alias("owasp_category"), F.col("props.cvss").alias("cvss_score"), F.round(confidence, 4).alias("confidence"), *location(F.col("place")), F.col("tool").alias("extractor"))


def adapter_facts(reports: DataFrame) -> DataFrame:
    """The second mapping: error is a critical vulnerability named by its rule, warning a smell, all else a minor vulnerability. Places
    must be complete; a result without one is an error."""
    rows = results(reports)
    error, warning = F.col("level") == "error", F.col("level") == "warning"
    line = F.col("place.region.startLine")
    checked = F.when(line.isNotNull() & F.col("place.region.startColumn").isNotNull(), line).otherwise(F.raise_error(F.lit("a result has no region")).cast("int"))
    return rows.select(F.when(warning, "CodeSmell").otherwise("Vulnerability").alias("fact_type"), F.when(error, "Critical").when(warning, "Major").otherwise("Minor").alias("severity"), F.when(error, 0.9).when(warning, F.lit(None)).otherwise(0.5).alias("confidence"), F.when(~warning, F.col("rule")).alias("cwe_id"), F.col("text").alias("message"), F.col("place.artifactLocation.uri").alias("file"), checked.alias("start_line"))


def linter_facts(rows: DataFrame, root: str = "") -> DataFrame:
    """Every diagnostic is a vulnerability; its code names the category."""
    path = relative(F.col("filename"), root) if root else F.col("filename")
    return rows.select(F.lit("Vulnerability").alias("fact_type"), mapped("severity", FROM_LINTER, "Minor").alias("severity"), F.concat(F.lit("ruff-"), "code").alias("owasp_category"), F.concat(F.lit("["), "code", F.lit("] "), "message").alias("message"), path.alias("file"), F.col("line").alias("start_line"), F.coalesce("endLine", "line").alias("end_line"), F.col("column").alias("start_column"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """package, class, method, nr, mi, ci of coverage XML: a row a line."""
    schema = "_name STRING, class ARRAY<STRUCT<_name: STRING, _sourcefilename: STRING, method: ARRAY<STRUCT<_name: STRING, _line: INT, line: ARRAY<STRUCT<_nr: INT, _mi: INT, _ci: INT, _mb: INT, _cb: INT>>>>, line: ARRAY<STRUCT<_nr: INT, _mi: INT, _ci: INT, _mb: INT, _cb: INT>>>>"
    packages = spark.read.format("xml").schema(schema).option("rowTag", "package").load(path)
    classes = packages.select(F.col("_name").alias("package"), F.explode("class").alias("c"))
    inner = F.flatten(F.transform(F.coalesce("c.method", F.array()), lambda m: F.coalesce(m["line"], F.array())))
    lines = classes.select("package", F.col("c._name").alias("class"), F.col("c._sourcefilename").alias("source"), F.explode(F.concat(inner, F.coalesce("c.line", F.array()))).alias("l"))
    return lines.select("package", "class", "source", F.col("l._nr").alias("nr"), F.col("l._mi").alias("mi"), F.col("l._ci").alias("ci"))


def source_path(package: Column, name: Column) -> Column:
    """Path of a class: its package and simple name; the package is not repeated where the name has it."""
    simple = F.regexp_extract(name, r"([^./$]+)(?:\$.*)?$", 1)
    return F.concat(F.regexp_replace(package, r"\.", "/"), F.lit("/"), simple, F.lit(".java"))


def uncovered(lines: DataFrame) -> DataFrame:
    """A fact for each line that has missed instructions or no covered ones."""
    return lines.where((F.col("mi") > 0) | (F.col("ci") == 0)).select(F.lit("UncoveredLine").alias("fact_type"), source_path(F.col("package"), F.col("class")).alias("file"), F.col("nr").alias("start_line"), F.col("nr").alias("end_line"))


def line_coverage(lines: DataFrame) -> DataFrame:
    total = F.col("mi") + F.col("ci")
    return lines.select("package", "class", "nr", F.round(F.when(total > 0, F.col("ci") * 100.0 / total).otherwise(0.0), 4).alias("percent"))
