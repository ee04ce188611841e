"""Registered queries over whole snapshots, flows, batches and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import severity as sev
from factloom.functions import text as tx
from factloom.operators import governance as gov
from factloom.operators import graph, quality, rules
from factloom.queries import _CHANGE, _T, PROJECT, Views, _now, query

# Functions and scores.
query(
    "fn_04_normalized",
    lambda v: v.table("documents").agg(F.count_distinct(F.sha2(tx.normalized(F.col("text")), 256)).alias("n")),
    "SELECT count(DISTINCT sha256(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'))) AS n FROM documents",
)
_PENALTY = "greatest(0.0, 100.0 - 10 * count(*) FILTER (rated AND severity = 'Critical') - 5 * count(*) FILTER (rated AND severity = 'Major') - count(*) FILTER (rated AND severity = 'Minor'))::DOUBLE"
query("agg_03_score", lambda v: quality.score(v.facts), f"SELECT {_PENALTY} AS score FROM (SELECT *, fact_type IN ('Vulnerability', 'CodeSmell') AS rated FROM facts)", "facts")
query(
    "agg_03_score_by_file",
    lambda v: quality.score_by(v.facts, "file"),
    f"SELECT file, {_PENALTY} AS score FROM (SELECT *, fact_type IN ('Vulnerability', 'CodeSmell') AS rated FROM facts) GROUP BY file",
    "facts",
)

# Diffs of whole snapshots.
_SNAPSHOTS = f"base AS (SELECT * FROM stored_findings WHERE analysis_id % 2 = 0), head AS (SELECT * FROM stored_findings WHERE analysis_id % 2 = 1), olds AS (SELECT fingerprint, arg_max(severity, seq) AS old FROM base GROUP BY 1), ranked AS (SELECT h.fingerprint, h.file, h.line, o.old, h.severity, {sev.sql_case('h.severity', sev.SERVER_RANK, '0')} - {sev.sql_case('o.old', sev.SERVER_RANK, '0')} AS steps, {sev.sql_case('h.severity', sev.SERVER_RANK, '0')} AS level FROM head h JOIN olds o USING (fingerprint)), changes AS ({_CHANGE}), n AS (SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'resolved') AS resolved, count(*) FILTER (change = 'increased') AS increased, count(*) FILTER (change = 'decreased') AS decreased FROM changes)"
_TREND = "CASE WHEN new > resolved THEN 'Degrading' WHEN new < resolved THEN 'Improving' ELSE 'Stable' END"


def _snapshots(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.stored_findings.where("analysis_id % 2 = 0"), v.stored_findings.where("analysis_id % 2 = 1")


query(
    "join_13_new",
    lambda v: gov.new_findings(*_snapshots(v)).select("fingerprint", "file", "line"),
    f"WITH {_SNAPSHOTS} SELECT fingerprint, file, line FROM changes WHERE change = 'new'",
    "stored_findings",
)
query(
    "join_14_resolved",
    lambda v: gov.resolved_findings(*_snapshots(v)).select("fingerprint", "file", "line"),
    f"WITH {_SNAPSHOTS} SELECT fingerprint, file, line FROM changes WHERE change = 'resolved'",
    "stored_findings",
)
query(
    "join_15_severity_changes",
    lambda v: gov.severity_changes(*_snapshots(v)),
    f"WITH {_SNAPSHOTS} SELECT fingerprint, file, line, old, severity, CASE WHEN steps > 0 THEN 'increased' ELSE 'decreased' END AS change, steps FROM "
    "ranked WHERE steps <> 0",
    "stored_findings",
)
query("join_16_diff", lambda v: gov.diff(*_snapshots(v)), f"WITH {_SNAPSHOTS} SELECT * FROM changes", "stored_findings")
query(
    "agg_25_diff_summary",
    lambda v: gov.diff_summary(*_snapshots(v)),
    f"WITH {_SNAPSHOTS} SELECT *, new - resolved AS net_change, (SELECT coalesce(sum(CASE WHEN steps > 0 THEN level ELSE -level END), 0)::BIGINT FROM "
    f"ranked WHERE steps <> 0) AS severity_score, {_TREND} AS trend FROM n",
    "stored_findings",
)
query(
    "rem_25_summary_text",
    lambda v: gov.summary_text(gov.diff_summary(*_snapshots(v))),
    f"WITH {_SNAPSHOTS} SELECT new || ' new, ' || resolved || ' resolved, ' || increased || ' more severe, ' || decreased || ' less severe: ' || {_TREND} "
    "AS text FROM n",
    "stored_findings",
)
query(
    "set_03_set_difference",
    lambda v: gov.diff(*_snapshots(v)).where("change IN ('new', 'resolved')").select("fingerprint", F.when(F.col("change") == "new", "head").otherwise("base").alias("side")),
    f"WITH {_SNAPSHOTS} SELECT fingerprint, CASE change WHEN 'new' THEN 'head' ELSE 'base' END AS side FROM changes WHERE change IN ('new', 'resolved')",
    "stored_findings",
)

# Flows, batches and the sort over all rows.
query(
    "join_05_flow",
    lambda v: rules.flow_join(v.flows),
    "SELECT a.flow_id, a.node AS source, b.node AS sink FROM flows a JOIN flows b USING (flow_id) WHERE a.fact_type = 'TaintSource' AND b.fact_type = "
    "'TaintSink'",
    "flows",
)
query(
    "graph_04_flow_edges",
    lambda v: graph.flow_edges(v.flows),
    "SELECT a.node AS src, b.node AS dst FROM flows a JOIN flows b USING (flow_id) WHERE (a.fact_type = 'TaintSource' AND b.fact_type = 'Sanitization') OR "
    "(a.fact_type = 'Sanitization' AND b.fact_type = 'TaintSink') OR (a.fact_type = 'TaintSource' AND b.fact_type = 'TaintSink' AND a.flow_id NOT IN "
    "(SELECT flow_id FROM flows WHERE fact_type = 'Sanitization'))",
    "flows",
)
query("srt_01_by_id", lambda v: v.facts.orderBy("fact_id").select("fact_id", "file"), "SELECT fact_id, file FROM facts ORDER BY fact_id", "facts")


def status_changes(v: Views) -> DataFrame:
    """A status for each finding; the last of a fingerprint counts."""
    return v.stored_findings.select(F.lit(PROJECT).alias("project"), "fingerprint", F.when(F.col("severity") == "Info", "wontfix").otherwise("accepted").alias("status"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), _now().alias("updated_at"), "seq", "analysis_id")


def _upserted(v: Views) -> DataFrame:
    return gov.upsert(v.baseline_status, status_changes(v), ["project", "fingerprint"], ["seq", "analysis_id"])


UPSERTED_SQL = f"WITH n AS (SELECT '{PROJECT}' AS project, fingerprint, arg_max(CASE WHEN severity = 'Info' THEN 'wontfix' ELSE 'accepted' END, (seq, analysis_id)) AS status, NULL::TIMESTAMP AS expires_at, {_T} AS updated_at FROM stored_findings GROUP BY fingerprint) SELECT * FROM n UNION ALL SELECT * FROM baseline_status b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project = b.project AND n.fingerprint = b.fingerprint)"
query("mut_01_upsert", _upserted, UPSERTED_SQL, "baseline_status", "stored_findings")
query(
    "mut_04_bulk_update",
    lambda v: _upserted(v).groupBy("status").agg(F.count("*").alias("n")),
    f"SELECT status, count(*) AS n FROM ({UPSERTED_SQL}) GROUP BY 1",
    "baseline_status",
    "stored_findings",
)


def _restored(v: Views) -> DataFrame:
    return gov.restored(v.baseline_status, *_snapshots(v), PROJECT, _now())


_RESTORED = f"WITH s AS (SELECT DISTINCT fingerprint FROM stored_findings WHERE analysis_id % 2 = 0), t AS (SELECT DISTINCT fingerprint FROM stored_findings WHERE analysis_id % 2 = 1) SELECT '{PROJECT}' AS project, fingerprint, 'accepted' AS status, NULL::TIMESTAMP AS expires_at, {_T} AS updated_at FROM s UNION ALL SELECT * FROM baseline_status WHERE NOT (project = '{PROJECT}' AND (fingerprint IN (SELECT fingerprint FROM s) OR fingerprint IN (SELECT fingerprint FROM t)))"
query(
    "mut_03_restore",
    lambda v: _restored(v).groupBy("project", "status").agg(F.count("*").alias("n")),
    f"SELECT project, status, count(*) AS n FROM ({_RESTORED}) GROUP BY ALL",
    "baseline_status",
    "stored_findings",
)
query("set_08_restored", _restored, _RESTORED, "baseline_status", "stored_findings")

# Graphs over the edges of all rows, by full keys.
_EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey % n AS dst FROM lineitem, (SELECT count(*) AS n FROM supplier) WHERE l_suppkey <> l_partkey % n"
_REACHED = f"WITH RECURSIVE e AS ({_EDGES}), r(node, depth) AS (SELECT src, 0::BIGINT FROM e WHERE src = 3 UNION SELECT dst, depth + 1 FROM e JOIN r ON src = node WHERE depth < (SELECT count(*) FROM supplier)) "


def _edges(v: Views) -> DataFrame:
    n = v.table("supplier").agg(F.count("*").alias("n"))
    ends = v.table("lineitem").select("l_suppkey", "l_partkey").crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n")).alias("dst"))
    return ends.where("src <> dst").distinct()


query("graph_01_reachable", lambda v: graph.reachable(_edges(v), 3).select("node"), _REACHED + "SELECT DISTINCT node FROM r")
query("graph_02_distances", lambda v: graph.reachable(_edges(v), 3), _REACHED + "SELECT node, min(depth) AS depth FROM r GROUP BY node")
query("graph_02_shortest_path", lambda v: graph.shortest_path(_edges(v), 3, 8).agg(F.max("step").alias("steps")), _REACHED + "SELECT min(depth) AS steps FROM r WHERE node = 8")
query(
    "graph_03_size",
    lambda v: _edges(v).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources")),
    f"SELECT count(*) AS edges, count(DISTINCT src) AS sources FROM ({_EDGES})",
)
