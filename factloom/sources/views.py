"""Deterministic views of the driver's tables as facts, analyses, findings and the like, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXTRACTORS = ("reports", "linter", "coverage", "patterns")

#: One text for both engines: plain SQL that each reads alike. {table} names stay as they are.
SQL = {
    "facts": """
SELECT sha256(concat_ws('|', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar), cast(l_partkey AS varchar), cast(l_suppkey AS varchar),
    cast(cast(round(l_quantity) AS bigint) AS varchar), cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar),
    cast(cast(round(l_discount * 100) AS bigint) AS varchar), cast(cast(round(l_tax * 100) AS bigint) AS varchar), l_returnflag, l_linestatus, substr(cast(l_shipdate AS varchar), 1, 10))) AS fact_id,
  CASE l_returnflag WHEN 'A' THEN 'Vulnerability' WHEN 'R' THEN 'UncoveredLine' ELSE 'CodeSmell' END AS fact_type,
  'order/' || cast(l_orderkey AS varchar) AS file, l_linenumber AS start_line, l_linenumber + cast(l_quantity AS int) % 5 AS end_line,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE cast(l_suppkey % 80 + 1 AS int) END AS start_column, cast(NULL AS int) AS end_column,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' AND l_discount >= 0.095 THEN 'Blocker' WHEN l_linestatus = 'F' AND l_discount >= 0.075 THEN 'Critical'
    WHEN l_discount >= 0.045 THEN 'Major' WHEN l_discount >= 0.015 THEN 'Minor' ELSE 'Info' END AS severity,
  round(1 - l_tax, 2) AS confidence, 'flow-' || cast(l_partkey AS varchar) AS flow_id, 'var' || cast(l_partkey % 50 AS varchar) AS var,
  CASE l_suppkey % 4 WHEN 0 THEN 'reports' WHEN 1 THEN 'linter' WHEN 2 THEN 'coverage' ELSE 'patterns' END AS extractor,
  CASE l_returnflag WHEN 'A' THEN 'weakness ' WHEN 'R' THEN 'Uncovered line ' ELSE 'Code smell ' END || cast(l_partkey % 20 AS varchar) AS message,
  'CWE-' || cast(l_partkey % 90 + 1 AS varchar) AS cwe_id, cast(l_quantity AS int) AS lines_of_code, l_shipdate AS extracted_at
FROM lineitem""",
    "coverage": """
SELECT 'order/' || cast(o_orderkey AS varchar) AS file, cast(o_orderkey % 101 AS int) AS line_coverage, cast(floor(o_totalprice / 100) AS bigint) AS total_lines, o_orderpriority AS scope
FROM orders""",
    "flows": """
SELECT 'flow-' || cast(l_partkey AS varchar) AS flow_id, CASE l_returnflag WHEN 'A' THEN 'TaintSource' WHEN 'R' THEN 'TaintSink' ELSE 'Sanitization' END AS fact_type,
  'n' || cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_suppkey AS varchar) AS node,
  CASE l_suppkey % 4 WHEN 0 THEN 'request_param' WHEN 1 THEN 'query_text' WHEN 2 THEN 'file_name' ELSE 'header' END AS var,
  CASE l_suppkey % 3 WHEN 0 THEN 'execute_query' WHEN 1 THEN 'render_page' ELSE 'open_file' END AS func,
  CASE l_suppkey % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'xss' ELSE 'path' END AS category,
  CASE l_suppkey % 2 WHEN 0 THEN 'escape_html' ELSE 'bind_value' END AS method, l_discount >= 0.05 AS effective
FROM lineitem""",
    "flow_steps": """
SELECT 'flow-' || cast(l_partkey AS varchar) AS flow_id, CASE l_returnflag WHEN 'A' THEN 'TaintSource' WHEN 'R' THEN 'TaintSink' ELSE 'Sanitization' END AS fact_type,
  'n' || cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) || '-' || cast(l_suppkey AS varchar) AS node, l_orderkey AS file_id, l_linenumber AS line,
  CASE l_suppkey % 4 WHEN 0 THEN 'request_param' WHEN 1 THEN 'query_text' WHEN 2 THEN 'file_name' ELSE 'header' END AS var,
  CASE l_suppkey % 3 WHEN 0 THEN 'execute_query' WHEN 1 THEN 'render_page' ELSE 'open_file' END AS func, l_discount >= 0.05 AS effective,
  l_discount >= 0.095 AND l_quantity < 10.5 AS untrusted
FROM lineitem""",
    "analyses": """
SELECT o_orderkey AS analysis_id, 'project-' || cast(o_custkey % 10 AS varchar) AS project, o_orderpriority AS branch, 'c' || cast(o_orderkey % 500 AS varchar) AS commit_id, o_orderdate AS ts,
  cast(floor(o_totalprice / 1000) AS int) AS duration_ms
FROM orders""",
    "stored_findings": """
SELECT l_orderkey AS analysis_id, l_linenumber AS line, cast(l_suppkey % 80 + 1 AS int) AS col, 'file-' || cast(l_suppkey AS varchar) AS file,
  sha256(cast(l_partkey % 2000 AS varchar) || '|' || cast(l_suppkey % 7 AS varchar)) AS fingerprint,
  CASE l_returnflag WHEN 'A' THEN 'Vulnerability' WHEN 'R' THEN 'UncoveredLine' ELSE 'CodeSmell' END AS fact_type,
  CASE WHEN l_discount >= 0.075 THEN 'Critical' WHEN l_discount >= 0.045 THEN 'Major' WHEN l_discount >= 0.015 THEN 'Minor' ELSE 'Info' END AS severity,
  cast(round(l_extendedprice * 100) AS bigint) * 10 + l_linenumber AS seq, 'finding ' || cast(l_partkey AS varchar) AS message
FROM lineitem""",
    "baseline_status": """
SELECT 'project-' || cast(p_partkey % 10 AS varchar) AS project, sha256(cast(p_partkey % 2000 AS varchar) || '|' || cast(p_size % 7 AS varchar)) AS fingerprint,
  CASE WHEN max(p_size) < 15 THEN 'accepted' WHEN max(p_size) < 30 THEN 'wontfix' WHEN max(p_size) < 40 THEN 'false_positive' ELSE 'active' END AS status,
  CASE WHEN max(p_size) % 3 = 0 THEN NULL ELSE TIMESTAMP '1996-01-01 00:00:00' + max(p_size) % 9 * INTERVAL '365' DAY END AS expires_at,
  TIMESTAMP '1995-01-01 00:00:00' + max(p_size) * INTERVAL '1' DAY AS updated_at
FROM part GROUP BY 1, 2""",
    "custom": """
SELECT event_id, 'events:' || event_type AS discriminant, props AS data, user_id, value, ts FROM events""",
}

#: Time at which queries that need one take "now" to be.
NOW = "2000-01-01 00:00:00"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over Parquet. Spark reads the SQL with its own type and hash names; nothing is evaluated here."""
    base = {"facts": "lineitem", "coverage": "orders", "flows": "lineitem", "flow_steps": "lineitem", "analyses": "orders", "stored_findings": "lineitem", "baseline_status": "part", "custom": "events"}[name]
    text = SQL[name].replace("AS varchar)", "AS string)").replace("sha256(", "sha2_256(").replace(f"FROM {base}", "FROM {source}")
    out, at = "", 0
    while (k := text.find("sha2_256(", at)) >= 0:  # sha256(x) is sha2(x, 256) here
        depth, end = 1, k + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += text[at:k] + "sha2(" + text[k + 9 : end - 1] + ", 256)"
        at = end
    return spark.sql(out + text[at:], source=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def with_views(body: str, *names: str) -> str:
    """Oracle SQL: the views that body reads, and body."""
    views = [f"{n} AS ({SQL[n]})" for n in names]
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*views, body.lstrip()[len("WITH RECURSIVE") :]])
    if body.lstrip().upper().startswith("WITH"):
        return "WITH " + ", ".join([*views, body.lstrip()[4:]])
    return "WITH " + ", ".join(views) + body if views else body
