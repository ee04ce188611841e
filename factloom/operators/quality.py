"""Metrics, gates and metric queries over facts and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that the metrics name; all others are "Other". Fixed values.
NAMED_TYPES = ("TaintSource", "TaintSink", "Vulnerability", "CodeSmell", "Function")
PENALTY = {"Critical": 10, "Major": 5, "Minor": 1}
DEFAULT_GATES = [("critical-issues", "CriticalIssueCount", "GreaterThan", 0.0, "Block"), ("code-smells", "CodeSmellCount", "GreaterThan", 100.0, "Review"), ("coverage", "TestCoverage", "LessThan", 80.0, "Warn")]
#: Hours of debt that a finding of each severity stands for.
DEBT_HOURS = {"Blocker": 8.0, "Critical": 4.0, "Major": 2.0, "Minor": 0.5, "Info": 0.0}


def by_type(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.when(F.col("fact_type").isin(*NAMED_TYPES), F.col("fact_type")).otherwise("Other").alias("fact_type")).agg(F.count("*").alias("n"))


def by_severity(facts: DataFrame) -> DataFrame:
    known = F.when(F.col("fact_type").isin("Vulnerability", "CodeSmell"), F.col("severity"))
    return facts.groupBy(F.coalesce(known, F.lit("N/A")).alias("severity")).agg(F.count("*").alias("n"))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def score(facts: DataFrame) -> DataFrame:
    """100 less the penalties of all vulnerabilities and smells, 0 at least; a Blocker costs nothing, as specified."""
    return facts.agg(_score().alias("score"))


def score_by(facts: DataFrame, column: str) -> DataFrame:
    """score() of the facts of each value of a column."""
    return facts.groupBy(column).agg(_score().alias("score"))


def _score() -> Column:
    rated = F.col("fact_type").isin("Vulnerability", "CodeSmell")
    cost = sum(points * count_if(rated & (F.col("severity") == name)) for name, points in PENALTY.items())
    return F.greatest(F.lit(0.0), F.lit(100.0) - cost)


METRICS = {
    "FactCount": lambda: F.count("*").cast("double"),
    "CriticalIssueCount": lambda: count_if((F.col("fact_type") == "Vulnerability") & (F.col("severity") == "Critical")).cast("double"),
    "CodeSmellCount": lambda: count_if(F.col("fact_type") == "CodeSmell").cast("double"),
    "VulnerabilityCount": lambda: count_if(F.col("fact_type") == "Vulnerability").cast("double"),
}


def metrics(facts: DataFrame, coverage: DataFrame | None = None, custom: dict[str, Column] | None = None) -> DataFrame:
    """metric, value: all gate metrics in one pass; custom: registered aggregates by name."""
    named = METRICS | {k: (lambda c=c: c.cast("double")) for k, c in (custom or {}).items()}
    row = facts.agg(*[f().alias(name) for name, f in named.items()])
    out = row.unpivot([], list(named), "metric", "value")
    if coverage is not None:
        out = out.union(coverage.agg(F.coalesce(F.avg("line_coverage"), F.lit(0.0)).alias("value")).select(F.lit("TestCoverage").alias("metric"), "value"))
    return out


def violates(op: Column, value: Column, threshold: Column) -> Column:
    """Gate operators name the violation; Equal is violated by a difference."""
    return F.when(op == "GreaterThan", value > threshold).when(op == "LessThan", value < threshold).when(op == "GreaterOrEqual", value >= threshold).when(op == "LessOrEqual", value <= threshold).when(op == "Equal", value != threshold)


def passes(op: Column, value: Column, threshold: Column) -> Column:
    """Threshold operators name what passes."""
    return F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold).when(op == "<=", value <= threshold).when(op == "==", value == threshold).when(op == "!=", value != threshold)


def gates(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_GATES, "gate string, metric string, op string, threshold double, action string")


def evaluate(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """gate, value, threshold, action, violated; a metric that is missing counts as 0."""
    joined = rules.join(measured, "metric", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return joined.select("gate", "metric", F.round("value", 6).alias("value"), "threshold", "action", violates(F.col("op"), F.col("value"), F.col("threshold")).alias("violated"))


def verdict(evaluated: DataFrame) -> DataFrame:
    """blocked, reviews, warnings over all gates."""
    hit = lambda a: F.count_if(F.col("violated") & (F.col("action") == a))
    return evaluated.agg((hit("Block") > 0).alias("blocked"), hit("Review").alias("reviews"), hit("Warn").alias("warnings"))


def fail_conditions(findings: DataFrame, limits: list[tuple[str, str, int]]) -> DataFrame:
    """gate, severity, n, most, failed: at most so many findings of a severity."""
    spark = findings.sparkSession
    rules = spark.createDataFrame(limits, "gate string, severity string, most long")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return rules.join(counts, "severity", "left").select("gate", "severity", F.coalesce("n", F.lit(0)).alias("n"), "most", (F.coalesce("n", F.lit(0)) > F.col("most")).alias("failed"))


def filtered(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all (field, operator, literal) conditions; a missing value meets none."""
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "contains": lambda a, b: a.contains(b), "matches": lambda a, b: a.rlike(b), "=~": lambda a, b: a.rlike(b), "!~": lambda a, b: ~a.rlike(b)}
    return df.where(reduce(lambda x, y: x & y, [ops[o](F.col(f), F.lit(v) if o not in ("matches", "=~", "!~", "contains") else v) for f, o, v in conditions], F.lit(True)))


def aggregate(df: DataFrame, function: str, field: str | None = None) -> DataFrame:
    """One value; an empty average or sum is 0."""
    zero = F.lit(0.0)
    value = {"count": lambda: F.count("*").cast("double"), "avg": lambda: F.coalesce(F.avg(field), zero), "sum": lambda: F.coalesce(F.sum(field).cast("double"), zero), "max": lambda: F.max(field).cast("double"), "min": lambda: F.min(field).cast("double")}[function]()
    return df.agg(F.round(value, 6).alias("value"))


def percentile(df: DataFrame, field: str, p: float) -> DataFrame:
    """The value at floor(p / 100 * n), clamped, of the sorted values; 0 without any. Values are counted, not collected: the place is
    found in the running counts of distinct values, range by range."""
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    part = F.least(F.floor((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * 4096), F.lit(4095))
    parted = counts.crossJoin(F.broadcast(bounds)).withColumn("part", part)  # bounds is one row
    from pyspark.sql import Window

    sums = parted.groupBy("part").agg(F.sum("n").alias("m"))  # 4096 rows at most
    before = sums.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = F.least(F.floor(F.lit(p) / 100 * F.col("total")), F.col("total") - 1)
    reached = parted.join(before, "part").withColumn("upto", F.col("before") + inside).where(F.col("upto") > at)
    return reached.agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("value"))


def summary(facts: DataFrame) -> DataFrame:
    """One row: totals by severity and type, mean confidence, debt hours and findings per 1000 lines. Confidences are added up as decimals
    of 12 places (what is not a number counts as missing): a sum of doubles, and so a mean near a half of its last place, would follow
    the order of the rows."""
    hours = sum(h * count_if(F.col("severity") == s) for s, h in DEBT_HOURS.items())
    loc = F.sum("lines_of_code")
    found = count_if(F.col("fact_type") == "Vulnerability")
    return facts.agg(
        F.count("*").alias("total"), *[count_if(F.col("severity") == s).alias(s.lower()) for s in DEBT_HOURS],
        count_if(F.col("confidence") >= 0.9).alias("sure"), F.round(F.avg(F.col("confidence").try_cast("decimal(18,12)")), 6).cast("double").alias("mean_confidence"), hours.alias("debt_hours"),
        F.round(F.when(loc > 0, found * 1000.0 / loc).otherwise(0.0), 6).alias("density"),
    )


def prometheus(measured: DataFrame, prefix: str = "quality") -> DataFrame:
    """A line of exposition text for each metric."""
    return measured.select(F.format_string(f"{prefix}_%s %.2f", F.lower("metric"), "value").alias("line"))


def as_json(measured: DataFrame) -> DataFrame:
    return measured.select(F.to_json(F.struct("metric", "value")).alias("json"))


def html(measured: DataFrame) -> DataFrame:
    return measured.select(F.format_string("<tr><td>%s</td><td>%.2f</td></tr>", "metric", "value").alias("row"))
