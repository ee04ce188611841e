"""Semantic models and expectations: projections of node tables, package look-ups, snapshot and expectation comparisons, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_facts(nodes: DataFrame) -> DataFrame:
    """Functions of a control-flow graph and variables of a data-flow graph as facts; lines start at 1 where nodes start at 0."""
    return nodes.select(F.when(F.col("graph") == "cfg", "Function").otherwise("Variable").alias("fact_type"), "name", (F.col("node") + 1).cast("int").alias("start_line"), F.lit(0.9).alias("confidence"))


def methods_of(model: DataFrame, package: str) -> DataFrame:
    """class, method of a package, from rows with nested methods."""
    return model.where(F.col("package") == package).select("class", F.explode("methods").alias("m")).select("class", F.col("m.name").alias("method"), F.col("m.parameters").alias("parameters"))


def expectations(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome: matched, missing or unexpected, counting equal rows once each way."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    a, e = count(actual, "have").alias("a"), count(expected, "want").alias("e")
    joined = a.join(e, [F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "full_outer")
    outcome = F.when(F.col("want").isNull(), "unexpected").when(F.col("have").isNull(), "missing").otherwise("matched")
    return joined.select(*[F.coalesce(f"a.{k}", f"e.{k}").alias(k) for k in keys], outcome.alias("outcome"))


def snapshot_difference(df: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return df.exceptAll(golden).withColumn("side", F.lit("new")).union(golden.exceptAll(df).withColumn("side", F.lit("gone")))


def store_findings(findings: DataFrame, path: str, key: str = "project") -> None:
    """Append findings, in a directory a project."""
    findings.write.mode("append").partitionBy(key).parquet(path)


def store_in_database(findings: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append findings to a database, a thousand rows a statement; each task commits its own."""
    findings.write.option("batchsize", 1000).jdbc(url, table, "append", properties or {})


#: Confidence and place of made taint facts. Fixed values.
MEDIUM, HIGH, PLACE = 0.7, 0.9, "generated.rs"


def taint_facts(nodes: DataFrame) -> DataFrame:
    """fact_id, fact_type, name, category, severity, effective, flow_id, confidence, file, start_line of declared taint nodes.

    nodes: role (source, sink or sanitizer), name, category, flow. A source starts a flow of its own unless one is named; ids are hashes
    of the declaration, so reruns agree; nodes of other roles, and sinks and sanitizers without a flow, make no fact."""
    kind = F.when(F.col("role") == "source", "TaintSource").when(F.col("role") == "sink", "TaintSink").when(F.col("role") == "sanitizer", "Sanitization")
    own = F.sha2(F.concat_ws("|", "role", "name", "category", "flow"), 256)
    flow = F.when(F.col("role") == "source", F.coalesce("flow", own)).otherwise(F.col("flow"))
    rows = nodes.select(
        own.alias("fact_id"), kind.alias("fact_type"), "name", F.when(F.col("role") != "sanitizer", F.col("category")).alias("category"), F.when(F.col("role") == "sink", "Major").alias("severity"),
        F.when(F.col("role") == "sanitizer", True).alias("effective"), flow.alias("flow_id"), F.when(F.col("role") == "sanitizer", HIGH).otherwise(MEDIUM).alias("confidence"), F.lit(PLACE).alias("file"), F.lit(1).alias("start_line"),
    )
    return rows.where(F.col("fact_type").isNotNull() & F.col("flow_id").isNotNull())
