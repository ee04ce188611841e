"""Matching facts and making findings: unions, and joins by place, overlap and flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import template

#: Lines of a bucket in the overlap join.
BUCKET = 64
#: Findings of a rule beyond which it fails and gives none. Fixed value.
MOST_FINDINGS = 10_000


def match_union(facts: DataFrame, *kinds: str) -> DataFrame:
    """Facts that any pattern matches, each once."""
    return facts.where(F.col("fact_type").isin(*kinds)).dropDuplicates(["fact_id"])


def sides(facts: DataFrame, left: str, right: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The facts of two types, with columns renamed to left_* and right_*."""
    pick = lambda kind, name: facts.where(F.col("fact_type") == kind).select(*[F.col(c).alias(f"{name}_{c}") for c in columns])
    return pick(left, "left"), pick(right, "right")


def match_join(facts: DataFrame, left: str, right: str, on: Column, columns: list[str]) -> DataFrame:
    """Pairs of facts under a condition. Give it an equality: without one the join would be a product of both sides."""
    a, b = sides(facts, left, right, columns)
    return a.join(b, on)


def location_join(facts: DataFrame, left: str, right: str, columns: tuple[str, ...] = ("fact_id",)) -> DataFrame:
    """Facts of two types at the same file and line: an equality join that Spark can sort, hash or split as it sees fit."""
    a, b = sides(facts, left, right, ["file", "start_line", *columns])
    return a.join(b, (F.col("left_file") == F.col("right_file")) & (F.col("left_start_line") == F.col("right_start_line"))).drop("right_file", "right_start_line").withColumnsRenamed({"left_file": "file", "left_start_line": "start_line"})


def overlap_join(facts: DataFrame, left: str, right: str) -> DataFrame:
    """Facts of two types whose line ranges overlap in a file. Ranges meet in buckets of lines; a pair is kept in the first that both have."""
    a, b = sides(facts, left, right, ["file", "start_line", "end_line", "fact_id"])
    spread = lambda df, s: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{s}_start_line") / BUCKET), F.floor(F.col(f"{s}_end_line") / BUCKET))))
    met = spread(a, "left").alias("a").join(spread(b, "right").alias("b"), F.expr("left_file = right_file AND a.bucket = b.bucket"))
    met = met.where((F.col("left_start_line") <= F.col("right_end_line")) & (F.col("right_start_line") <= F.col("left_end_line")))
    first = F.floor(F.greatest("left_start_line", "right_start_line") / BUCKET)
    return met.where(F.col("a.bucket") == first).select(F.col("left_file").alias("file"), "left_fact_id", "right_fact_id")


def flow_join(flows: DataFrame) -> DataFrame:
    """Sources and sinks of one flow."""
    pick = lambda kind, name: flows.where(F.col("fact_type") == kind).select("flow_id", F.col("node").alias(name))
    return pick("TaintSource", "source").join(pick("TaintSink", "sink"), "flow_id")


def flow_pair_counts(flows: DataFrame) -> DataFrame:
    """Pairs of a source and a sink in each flow, without making them."""
    counts = flows.groupBy("flow_id").agg(F.count_if(F.col("fact_type") == "TaintSource").alias("sources"), F.count_if(F.col("fact_type") == "TaintSink").alias("sinks"))
    return counts.where((F.col("sources") > 0) & (F.col("sinks") > 0)).select("flow_id", "sources", "sinks", (F.col("sources") * F.col("sinks")).alias("pairs"))


def exists_all(facts: DataFrame, first: str, *others: str, on: tuple[str, ...] = ("file", "start_line")) -> DataFrame:
    """Facts of one type with facts of all other types at the same values of the shared variables."""
    out = facts.where(F.col("fact_type") == first)
    for kind in others:
        out = out.join(facts.where(F.col("fact_type") == kind).select(*on).distinct(), list(on), "left_semi")
    return out


def owners(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Facts with each owner whose path prefix starts the file. The prefix's own text is the key: files are cut at each slash."""
    depth = F.size(F.split("file", "/"))
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n), "/"))
    return facts.withColumn("prefix", F.explode(prefixes)).join(patterns, "prefix")


def findings(facts: DataFrame, rule: str, message: str, severity: Column, confidence: Column, metadata: Column | None = None) -> DataFrame:
    """Findings of one rule; the id is a hash of the rule and the fact, so reruns agree."""
    meta = F.create_map().cast("map<string,string>") if metadata is None else metadata
    rows = facts.withColumn("metadata", meta)
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(rule), "fact_id"), 256).alias("finding_id"), F.lit(rule).alias("rule_name"), template(message).alias("message"),
        "file", "start_line", "end_line", confidence.alias("confidence"), severity.alias("severity"), "metadata", F.array("fact_id").alias("fact_ids"),
    )


def capped(found: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The findings of the rules that stay within the limit; a rule beyond it fails as a whole. Counts are joined, not windowed."""
    good = found.groupBy("rule_name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("rule_name")
    return found.join(good, "rule_name", "left_semi")


def rule_results(found: DataFrame, rules: list[str], most: int = MOST_FINDINGS) -> DataFrame:
    """rule_name, n_findings, failed: a row for every rule, found or not."""
    names = found.sparkSession.createDataFrame([(r,) for r in rules], "rule_name string")
    counts = found.groupBy("rule_name").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return names.join(counts, "rule_name", "left").select("rule_name", F.when(n > most, F.lit(0)).otherwise(n).alias("n_findings"), (n > most).alias("failed"))


def rules_in_one_scan(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """fact_id, rule_name for every rule that a fact meets: one pass over the facts, whatever the number of rules."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return facts.select("fact_id", F.explode(hit).alias("rule_name"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; max_by combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest])


def numbered(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w))
