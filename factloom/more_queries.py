"""More of the registered queries: aggregates, windows, sets, changes, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import dynamic
from factloom.functions import severity as sev
from factloom.functions import text as tx
from factloom.operators import governance as gov
from factloom.operators import quality, rules
from factloom.queries import PROJECT, SPAN, Views, _now, lit_time, query
from factloom.sources.views import NOW

_T = f"TIMESTAMP '{NOW}'"
_COUNTS = "count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Major') AS major, count(*) FILTER (severity = 'Minor') AS minor, count(*) FILTER (severity = 'Info') AS info"

# Metrics and gates.
query(
    "agg_01_by_type",
    lambda v: quality.by_type(v.facts),
    "SELECT CASE WHEN fact_type IN ('TaintSource', 'TaintSink', 'Vulnerability', 'CodeSmell', 'Function') THEN fact_type ELSE 'Other' END AS fact_type, "
    "count(*) AS n FROM facts GROUP BY 1",
    "facts",
)
query(
    "agg_02_by_severity",
    lambda v: quality.by_severity(v.facts),
    "SELECT coalesce(CASE WHEN fact_type IN ('Vulnerability', 'CodeSmell') THEN severity END, 'N/A') AS severity, count(*) AS n FROM facts GROUP BY 1",
    "facts",
)
_METRICS = "SELECT 'FactCount' AS metric, count(*)::DOUBLE AS value FROM facts UNION ALL SELECT 'CriticalIssueCount', count(*) FILTER (fact_type = 'Vulnerability' AND severity = 'Critical') FROM facts UNION ALL SELECT 'CodeSmellCount', count(*) FILTER (fact_type = 'CodeSmell') FROM facts UNION ALL SELECT 'VulnerabilityCount', count(*) FILTER (fact_type = 'Vulnerability') FROM facts"
for _name, _metric in (("agg_07_fact_count", "FactCount"), ("agg_08_critical_count", "CriticalIssueCount")):
    query(_name, lambda v, m=_metric: quality.metrics(v.facts).where(F.col("metric") == m), f"SELECT * FROM ({_METRICS}) WHERE metric = '{_metric}'", "facts")
query(
    "agg_09_kind_counts",
    lambda v: quality.metrics(v.facts).where(F.col("metric").isin("CodeSmellCount", "VulnerabilityCount")),
    f"SELECT * FROM ({_METRICS}) WHERE metric IN ('CodeSmellCount', 'VulnerabilityCount')",
    "facts",
)
query(
    "agg_10_coverage_and_custom",
    lambda v: quality.metrics(v.facts, v.coverage, {"files": F.count_distinct("file")}).where(F.col("metric").isin("TestCoverage", "files")).select("metric", F.round("value", 6).alias("value")),
    "SELECT 'TestCoverage' AS metric, round(avg(line_coverage), 6) AS value FROM coverage UNION ALL SELECT 'files', count(DISTINCT file)::DOUBLE FROM facts",
    "facts",
    "coverage",
)
_EVALUATED = "SELECT gate, metric, round(value, 6) AS value, threshold, action, CASE WHEN action = 'Warn' THEN value < threshold ELSE value > threshold END AS violated FROM (SELECT * FROM g JOIN m USING (metric))"


def _evaluated(v: Views) -> DataFrame:
    return quality.evaluate(quality.metrics(v.facts, v.coverage), quality.gates(v.spark))


_GATES_SQL = "WITH g(gate, metric, threshold, action) AS (VALUES ('critical-issues', 'CriticalIssueCount', 0.0::DOUBLE, 'Block'), ('code-smells', 'CodeSmellCount', 100.0, 'Review'), ('coverage', 'TestCoverage', 80.0, 'Warn')), m AS (SELECT * FROM (" + _METRICS + ") UNION ALL SELECT 'TestCoverage', avg(line_coverage) FROM coverage) "
query("agg_11_gates", _evaluated, _GATES_SQL + _EVALUATED, "facts", "coverage")
query(
    "agg_11_verdict",
    lambda v: quality.verdict(_evaluated(v)),
    _GATES_SQL + f"SELECT count(*) FILTER (violated AND action = 'Block') > 0 AS blocked, count(*) FILTER (violated AND action = 'Review') AS reviews, count(*) FILTER (violated AND action = 'Warn') AS warnings FROM ({_EVALUATED})",
    "facts",
    "coverage",
)
query(
    "agg_12_default_gates",
    lambda v: quality.gates(v.spark),
    "SELECT * FROM (VALUES ('critical-issues', 'CriticalIssueCount', 'GreaterThan', 0.0::DOUBLE, 'Block'), ('code-smells', 'CodeSmellCount', "
    "'GreaterThan', 100.0, 'Review'), ('coverage', 'TestCoverage', 'LessThan', 80.0, 'Warn')) g(gate, metric, op, threshold, action)",
)
for _f in ("count", "avg", "sum"):
    query(f"agg_13_{_f}", lambda v, f=_f: quality.aggregate(v.facts.where("severity = 'Major'"), f, "lines_of_code"), f"SELECT round(coalesce({'count(*)' if _f == 'count' else f'{_f}(lines_of_code)'}, 0)::DOUBLE, 6) AS value FROM facts WHERE severity = 'Major'", "facts")
query("agg_13_empty_average", lambda v: quality.aggregate(v.facts.where("severity = 'None'"), "avg", "lines_of_code"), "SELECT 0.0::DOUBLE AS value")
for _p in (50, 95, 100):
    query(f"agg_14_percentile_{_p}", lambda v, p=_p: quality.percentile(v.coverage, "total_lines", p), f"SELECT total_lines::DOUBLE AS value FROM (SELECT total_lines, row_number() OVER (ORDER BY total_lines) - 1 AS i, count(*) OVER () AS n FROM coverage) WHERE i = least(floor({_p} / 100.0 * n), n - 1)", "coverage")
for _f in ("max", "min"):
    query(f"agg_15_{_f}", lambda v, f=_f: quality.aggregate(v.coverage, f, "line_coverage"), f"SELECT {_f}(line_coverage)::DOUBLE AS value FROM coverage", "coverage")
_OPS = ((">", 50), (">=", 50), ("<", 50), ("<=", 50), ("==", 50), ("!=", 50))
query(
    "agg_16_thresholds",
    lambda v: v.coverage.agg(F.floor(F.avg("line_coverage")).cast("double").alias("value")).crossJoin(F.broadcast(v.spark.createDataFrame(_OPS, "op string, threshold int"))).select("op", quality.passes(F.col("op"), F.col("value"), F.col("threshold")).alias("passed")),
    "SELECT op, CASE op WHEN '>' THEN x > 50 WHEN '>=' THEN x >= 50 WHEN '<' THEN x < 50 WHEN '<=' THEN x <= 50 WHEN '==' THEN x = 50 ELSE x <> 50 END AS "
    "passed FROM (SELECT floor(avg(line_coverage)) AS x FROM coverage), (VALUES ('>'), ('>='), ('<'), ('<='), ('=='), ('!=')) o(op)",
    "coverage",
)
query(
    "agg_17_findings_gate",
    lambda v: quality.summary(v.facts).select((F.col("critical") > 5).alias("too_critical"), (F.col("debt_hours") > 100).alias("too_much_debt"), ((F.col("critical") > 5) & (F.col("density") > 1)).alias("both")),
    "SELECT count(*) FILTER (severity = 'Critical') > 5 AS too_critical, sum(CASE severity WHEN 'Blocker' THEN 8 WHEN 'Critical' THEN 4 WHEN 'Major' THEN "
    "2 WHEN 'Minor' THEN 0.5 ELSE 0 END) > 100 AS too_much_debt, count(*) FILTER (severity = 'Critical') > 5 AND count(*) FILTER (fact_type = "
    "'Vulnerability') * 1000.0 / sum(lines_of_code) > 1 AS both FROM facts",
    "facts",
)
query(
    "agg_18_fail_conditions",
    lambda v: quality.fail_conditions(v.facts, [("release", "Critical", 10), ("release", "Blocker", 0), ("nightly", "Critical", 100000), ("nightly", "Fatal", 0)]),
    "SELECT gate, g.severity, count(f.fact_id) AS n, most, count(f.fact_id) > most AS failed FROM (VALUES ('release', 'Critical', 10::BIGINT), ('release', "
    "'Blocker', 0), ('nightly', 'Critical', 100000), ('nightly', 'Fatal', 0)) g(gate, severity, most) LEFT JOIN facts f ON f.severity = g.severity GROUP "
    "BY gate, g.severity, most",
    "facts",
)
query(
    "agg_19_summary",
    lambda v: quality.summary(v.store),
    "SELECT count(*) AS total, count(*) FILTER (severity = 'Blocker') AS blocker, " + _COUNTS + ", count(*) FILTER (confidence >= 0.9) AS sure, round(avg(confidence), 6) AS mean_confidence, sum(CASE severity WHEN 'Blocker' THEN 8 WHEN 'Critical' THEN 4 WHEN 'Major' THEN 2 WHEN 'Minor' THEN 0.5 ELSE 0 END)::DOUBLE AS debt_hours, round(count(*) FILTER (fact_type = 'Vulnerability') * 1000.0 / sum(lines_of_code), 6) AS density FROM facts",
    "facts",
)
query(
    "agg_20_prometheus",
    lambda v: quality.prometheus(quality.metrics(v.facts)),
    f"SELECT 'quality_' || lower(metric) || ' ' || printf('%.2f', value) AS line FROM ({_METRICS})",
    "facts",
)
query(
    "agg_20_html",
    lambda v: quality.html(quality.metrics(v.facts)),
    f"SELECT '<tr><td>' || metric || '</td><td>' || printf('%.2f', value) || '</td></tr>' AS row FROM ({_METRICS})",
    "facts",
)
query(
    "agg_20_json",
    lambda v: quality.as_json(quality.metrics(v.facts)).select(F.get_json_object("json", "$.metric").alias("metric"), F.get_json_object("json", "$.value").cast("double").alias("value")),
    _METRICS,
    "facts",
)

# Trends and summaries.
_S, _E = (f"TIMESTAMP '{t}'" for t in SPAN)
query(
    "agg_21_trend_metrics",
    lambda v: gov.trend_metrics(v.analyses, v.stored_findings, PROJECT, *map(lit_time, SPAN)),
    f"SELECT count(*) AS total, {_COUNTS} FROM stored_findings JOIN analyses USING (analysis_id) WHERE project = '{PROJECT}' AND ts BETWEEN {_S} AND {_E}",
    "analyses",
    "stored_findings",
)


def _change(v: Views) -> DataFrame:
    half = lit_time("1996-01-01 00:00:00")
    now = gov.trend_metrics(v.analyses, v.stored_findings, PROJECT, half, lit_time(SPAN[1])).select(F.lit("now").alias("k"), "total")
    before = gov.trend_metrics(v.analyses, v.stored_findings, PROJECT, lit_time(SPAN[0]), half - F.expr("INTERVAL 1 SECOND")).select(F.lit("before"), "total")
    both = now.union(before).agg(F.max(F.when(F.col("k") == "now", F.col("total"))).alias("n"), F.max(F.when(F.col("k") == "before", F.col("total"))).alias("previous"))
    return both.withColumn("change_percent", F.round(F.when(F.col("previous") > 0, (F.col("n") - F.col("previous")) * 100.0 / F.col("previous")).otherwise(0.0), 4))


query(
    "agg_22_trend_percent",
    _change,
    "SELECT n, previous, round(CASE WHEN previous > 0 THEN (n - previous) * 100.0 / previous ELSE 0 END, 4) AS change_percent FROM (SELECT count(*) FILTER "
    "(ts >= TIMESTAMP '1996-01-01') AS n, count(*) FILTER (ts < TIMESTAMP '1996-01-01') AS previous FROM stored_findings JOIN analyses USING (analysis_id) "
    f"WHERE project = '{PROJECT}' AND ts BETWEEN {_S} AND {_E})",
    "analyses",
    "stored_findings",
)
query(
    "agg_23_daily",
    lambda v: gov.daily(v.analyses, v.stored_findings),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, project, branch, severity, fact_type, count(*) AS n FROM stored_findings JOIN analyses USING "
    "(analysis_id) GROUP BY ALL",
    "analyses",
    "stored_findings",
)


def _publish(v: Views) -> DataFrame:
    shown = gov.without_baseline(v.stored_findings, v.baseline_status, PROJECT, _now()).agg(F.count("*").alias("new"))
    return shown.crossJoin(F.broadcast(v.stored_findings.agg(F.count("*").alias("total")))).select("new", (F.col("total") - F.col("new")).alias("resolved"), gov.trend(F.col("new"), F.col("total") - F.col("new")).alias("trend"))


query(
    "agg_26_publish_summary",
    _publish,
    "SELECT new, total - new AS resolved, CASE WHEN new > total - new THEN 'Degrading' WHEN new < total - new THEN 'Improving' ELSE 'Stable' END AS trend "
    f"FROM (SELECT count(*) FILTER (fingerprint NOT IN (SELECT fingerprint FROM baseline_status WHERE project = '{PROJECT}' AND (expires_at IS NULL OR "
    f"expires_at >= {_T}))) AS new, count(*) AS total FROM stored_findings)",
    "stored_findings",
    "baseline_status",
)
query("agg_27_severity_counts", lambda v: gov.severity_counts(v.stored_findings), f"SELECT {_COUNTS} FROM stored_findings", "stored_findings")
query(
    "agg_28_status_counts",
    lambda v: v.baseline_status.groupBy("status").agg(F.count("*").alias("n")),
    "SELECT status, count(*) AS n FROM baseline_status GROUP BY 1",
    "baseline_status",
)

# Fingerprints. Both sides of the hash are built alike; null columns have their own mark.
_FP = "sha256(concat_ws(chr(1), fact_type, lower(file), start_line::VARCHAR, coalesce(start_column::VARCHAR, chr(0)), lower(trim(message))))"
_FP_LOOSE = "sha256(concat_ws(chr(1), fact_type, lower(file), start_line::VARCHAR, lower(trim(message))))"
query("set_04_fingerprints", lambda v: v.facts.select("fact_id", gov.fingerprint().alias("fingerprint")), f"SELECT fact_id, {_FP} AS fingerprint FROM facts", "facts")
query(
    "set_04_deduplicated",
    lambda v: gov.deduplicated(v.store, gov.fingerprint(columns=False), ["extractor", "fact_id"], whole=False).select("fingerprint", "fact_id"),
    f"SELECT fingerprint, fact_id FROM (SELECT {_FP_LOOSE} AS fingerprint, fact_id, row_number() OVER (PARTITION BY {_FP_LOOSE} ORDER BY extractor, "
    "fact_id) AS nth FROM facts) WHERE nth = 1",
    "facts",
)
query(
    "win_02_first_by_fingerprint",
    lambda v: gov.deduplicated(v.facts, F.sha2("message", 256), ["extracted_at", "fact_id"]).select("message", "fact_id"),
    "SELECT message, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY message ORDER BY extracted_at, fact_id) = 1",
    "facts",
)
query(
    "agg_29_dedup_statistics",
    lambda v: gov.dedup_statistics(v.facts, gov.fingerprint(columns=False)),
    "SELECT count(*) AS before, count(DISTINCT fp) AS after, count(*) - count(DISTINCT fp) AS removed, round((count(*) - count(DISTINCT fp)) / "
    f"count(*)::DOUBLE, 6) AS ratio FROM (SELECT {_FP_LOOSE} AS fp FROM facts)",
    "facts",
)
query(
    "agg_30_extractor_totals",
    lambda v: v.facts.groupBy("extractor").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.max("extracted_at").alias("last_at")),
    "SELECT extractor, count(*) AS n, count(DISTINCT file) AS files, max(extracted_at) AS last_at FROM facts GROUP BY 1",
    "facts",
)

# Rules over one scan.
_RULES = {"critical": (F.col, "severity = 'Critical'"), "late": (F.col, "start_line >= 6"), "unsure": (F.col, "confidence < 0.95"), "never": (F.col, "start_line > 1000")}


def _hits(v: Views) -> DataFrame:
    return rules.rules_in_one_scan(v.store, {name: F.expr(text) for name, (_, text) in _RULES.items()})


_HITS = " UNION ALL ".join(f"SELECT fact_id, '{n}' AS rule_name FROM facts WHERE {t}" for n, (_, t) in _RULES.items())
query("rule_many_in_one_scan", _hits, _HITS, "facts")
query(
    "agg_31_rule_results",
    lambda v: rules.rule_results(_hits(v), list(_RULES), 10_000).select("rule_name", "n_findings", "failed"),
    "SELECT r.rule_name, CASE WHEN count(h.fact_id) > 10000 THEN 0 ELSE count(h.fact_id) END AS n_findings, count(h.fact_id) > 10000 AS failed FROM "
    f"(VALUES ('critical'), ('late'), ('unsure'), ('never')) r(rule_name) LEFT JOIN ({_HITS}) h USING (rule_name) GROUP BY 1",
    "facts",
)
query(
    "win_03_capped",
    lambda v: rules.capped(_hits(v), 9000),
    f"WITH h AS ({_HITS}) SELECT fact_id, rule_name FROM h WHERE rule_name IN (SELECT rule_name FROM h GROUP BY 1 HAVING count(*) <= 9000)",
    "facts",
)
query(
    "srt_05_failed_rules",
    lambda v: rules.rule_results(_hits(v), list(_RULES), 9000).where("failed").select("rule_name"),
    f"SELECT rule_name FROM ({_HITS}) GROUP BY 1 HAVING count(*) > 9000",
    "facts",
)
query(
    "agg_32_batch_counters",
    lambda v: v.facts.agg(F.count_distinct("file").alias("files"), F.count("*").alias("matches"), F.count_if(F.col("severity").isNull()).alias("unrated")),
    "SELECT count(DISTINCT file) AS files, count(*) AS matches, count(*) FILTER (severity IS NULL) AS unrated FROM facts",
    "facts",
)
query(
    "agg_33_success_rate",
    lambda v: v.facts.groupBy("extractor").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") > 0.95).alias("passed"), F.round(F.avg((F.col("confidence") > 0.95).cast("double")), 6).alias("rate")),
    "SELECT extractor, count(*) AS total, count(*) FILTER (confidence > 0.95) AS passed, round(avg((confidence > 0.95)::INT), 6) AS rate FROM facts GROUP "
    "BY 1",
    "facts",
)
query(
    "agg_34_catalogue_counts",
    lambda v: v.facts.groupBy(tx.cwe(F.col("cwe_id")).alias("cwe"), "severity").agg(F.count("*").alias("n")),
    "SELECT substr(cwe_id, 5)::INT AS cwe, severity, count(*) AS n FROM facts GROUP BY ALL",
    "facts",
)
query(
    "agg_39_having_count",
    lambda v: v.facts.where("fact_type = 'CodeSmell'").groupBy("file").agg(F.count("*").alias("n")).where("n > 3"),
    "SELECT file, count(*) AS n FROM facts WHERE fact_type = 'CodeSmell' GROUP BY 1 HAVING count(*) > 3",
    "facts",
)

# Windows, sorts.
query(
    "win_01_latest",
    lambda v: rules.latest(v.analyses, ["project", "branch"], ["ts", "analysis_id"]).select("project", "branch", "analysis_id", "ts"),
    "SELECT project, branch, analysis_id, ts FROM analyses QUALIFY row_number() OVER (PARTITION BY project, branch ORDER BY ts DESC, analysis_id DESC) = 1",
    "analyses",
)
query(
    "win_04_neighbours",
    lambda v: rules.numbered(v.stored_findings, ["analysis_id"], ["line", "col", "seq", "fingerprint"]).select("analysis_id", "nth", "line"),
    "SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY line, col, seq, fingerprint)::INT AS nth, line FROM stored_findings",
    "stored_findings",
)


def _weekly(v: Views) -> DataFrame:
    from pyspark.sql import Window

    days = v.table("events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return days.withColumn("change_percent", F.round((F.col("n") - before) * 100.0 / before, 4))


query(
    "win_05_change_by_day",
    _weekly,
    "SELECT event_type, day, n, round((n - lag(n) OVER w) * 100.0 / lag(n) OVER w, 4) AS change_percent FROM (SELECT event_type, date_trunc('day', "
    "ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day)",
)
query(
    "srt_02_by_place",
    lambda v: v.stored_findings.where("analysis_id = 7").orderBy("line", "col").select("line", "col", "fingerprint"),
    "SELECT line, col, fingerprint FROM stored_findings WHERE analysis_id = 7 ORDER BY 1, 2",
    "stored_findings",
)
query(
    "src_36_findings_of_analysis",
    lambda v: v.stored_findings.where("analysis_id = 33").orderBy("line", "col").select("line", "col", "message", "severity"),
    "SELECT line, col, message, severity FROM stored_findings WHERE analysis_id = 33",
    "stored_findings",
)
query(
    "srt_03_audit_trail",
    lambda v: v.baseline_status.orderBy(F.desc("updated_at"), "project", "fingerprint").limit(100),
    "SELECT * FROM baseline_status ORDER BY updated_at DESC, project, fingerprint LIMIT 100",
    "baseline_status",
)
query(
    "srt_04_recent_analyses",
    lambda v: v.analyses.where(F.col("project") == PROJECT).orderBy(F.desc("ts"), F.desc("analysis_id")).limit(20),
    f"SELECT * FROM analyses WHERE project = '{PROJECT}' ORDER BY ts DESC, analysis_id DESC LIMIT 20",
    "analyses",
)
query(
    "src_35_latest_of_project",
    lambda v: v.analyses.where(F.col("project") == PROJECT).orderBy(F.desc("ts"), F.desc("analysis_id")).limit(1),
    f"SELECT * FROM analyses WHERE project = '{PROJECT}' ORDER BY ts DESC, analysis_id DESC LIMIT 1",
    "analyses",
)
query(
    "srt_06_most_results",
    lambda v: v.facts.orderBy(F.desc("confidence"), "fact_id").limit(25).select("fact_id"),
    "SELECT fact_id FROM facts ORDER BY confidence DESC, fact_id LIMIT 25",
    "facts",
)
query(
    "srt_07_top_files",
    lambda v: v.stored_findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(10),
    "SELECT file, count(*) AS n FROM stored_findings GROUP BY 1 ORDER BY n DESC, file LIMIT 10",
    "stored_findings",
)

# Sets and changes of state.
query(
    "set_01_union_by_id",
    lambda v: v.facts.where("severity = 'Major'").unionByName(v.facts.where("start_line = 1")).dropDuplicates(["fact_id"]).select("fact_id"),
    "SELECT fact_id FROM facts WHERE severity = 'Major' UNION SELECT fact_id FROM facts WHERE start_line = 1",
    "facts",
)
query(
    "set_02_bag_union",
    lambda v: v.facts.where("severity = 'Major'").unionByName(v.facts.where("start_line = 1")).select("fact_id"),
    "SELECT fact_id FROM facts WHERE severity = 'Major' UNION ALL SELECT fact_id FROM facts WHERE start_line = 1",
    "facts",
)
query(
    "set_05_index_intersection",
    lambda v: v.facts.where("severity = 'Major'").select("fact_id").intersect(v.facts.where("start_line = 1").select("fact_id")),
    "SELECT fact_id FROM facts WHERE severity = 'Major' INTERSECT SELECT fact_id FROM facts WHERE start_line = 1",
    "facts",
)


def _versions(v: Views) -> tuple[DataFrame, DataFrame]:
    docs = v.table("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 5 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


_CHANGED = "SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'Added' WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 'Deleted' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'Modified' END AS change FROM documents"
query("set_06_changes", lambda v: gov.changes(*_versions(v)), f"SELECT * FROM ({_CHANGED}) WHERE change IS NOT NULL")
query(
    "src_37_changed_files",
    lambda v: gov.changes(*_versions(v)).where("change <> 'Deleted'").select("path"),
    f"SELECT path FROM ({_CHANGED}) WHERE change IN ('Added', 'Modified')",
)
query(
    "str_08_scan_mode",
    lambda v: gov.scan_mode(gov.changes(*_versions(v)), v.table("documents").count()),
    "SELECT n AS n_changed, round(n / total::DOUBLE, 6) AS share, CASE WHEN n / total::DOUBLE > 0.3 OR n > 1000 THEN 'full' ELSE 'incremental' END AS mode "
    f"FROM (SELECT count(change) AS n, count(*) AS total FROM ({_CHANGED}))",
)
query(
    "agg_37_incremental_statistics", lambda v: gov.changes(*_versions(v)).agg(F.count("*").alias("n")).select(*gov.incremental_statistics(F.col("n"), v.table("documents").count())),
    f"SELECT n AS changed, round(s * 100, 4) AS change_percent, round(h, 6) AS cache_hit_rate, round(h * (1 - s), 6) AS efficiency FROM (SELECT *, CASE WHEN s > 0.3 OR n > 1000 THEN 0.0 ELSE 1 - s END AS h FROM (SELECT count(change) AS n, count(change) / count(*)::DOUBLE AS s FROM ({_CHANGED})))",
)
_EXTRACTOR = "SELECT 'extractor ' || {key} % 3000 AS name, min({ms} % 600 || 's') AS timeout, bool_and({ms} % 2 = 0) AS enabled FROM {table} GROUP BY 1"
_GLOBAL, _OWN = _EXTRACTOR.format(key="c_custkey", ms="c_nationkey", table="customer"), _EXTRACTOR.format(key="o_custkey * 2", ms="o_orderkey", table="orders")
query(
    "set_07_merged_config",
    lambda v: gov.upsert(*[v.spark.sql(t.replace(f"FROM {n}", "FROM {rows}"), rows=v.table(n)) for t, n in ((_GLOBAL, "customer"), (_OWN, "orders"))], ["name"]),
    f"WITH g AS ({_GLOBAL}), o AS ({_OWN}) SELECT * FROM o UNION ALL SELECT * FROM g WHERE name NOT IN (SELECT name FROM o)",
)


_ACTIONS = f"SELECT f.fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'accept' WHEN expires_at < {_T} THEN 'expired' WHEN status <> 'active' THEN 'refresh' ELSE 'none' END AS action FROM (SELECT DISTINCT fingerprint FROM stored_findings) f LEFT JOIN (SELECT * FROM baseline_status WHERE project = '{PROJECT}') b USING (fingerprint)"
query("mut_02_baseline_actions", lambda v: gov.baseline_actions(v.stored_findings, v.baseline_status, PROJECT, _now()), _ACTIONS, "baseline_status", "stored_findings")
query(
    "mut_02_action_counts",
    lambda v: gov.action_counts(gov.baseline_actions(v.stored_findings, v.baseline_status, PROJECT, _now())),
    "SELECT count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'refresh') AS refreshed, count(*) FILTER (action = 'expired') AS "
    f"expired FROM ({_ACTIONS})",
    "baseline_status",
    "stored_findings",
)


_UPDATES = f"SELECT CASE WHEN line = 7 THEN 'project-4' ELSE '{PROJECT}' END AS project, CASE WHEN line = 6 THEN '' ELSE fingerprint END AS fingerprint, CASE WHEN severity = 'Info' THEN 'unheard' ELSE 'accepted' END AS status FROM stored_findings"
_ERROR = "CASE WHEN fingerprint = '' THEN 'no fingerprint' WHEN status = 'unheard' THEN 'unknown status' WHEN (project, fingerprint) NOT IN (SELECT (project, fingerprint) FROM baseline_status) THEN 'unknown finding' END"
query(
    "mut_04_bulk_errors", lambda v: gov.bulk_updated(v.spark.sql(_UPDATES.replace("FROM stored_findings", "FROM {rows}"), rows=v.stored_findings), v.baseline_status).withColumn("errors", F.sha2(F.array_join("errors", ";"), 256)),
    f"WITH u AS ({_UPDATES}), e AS (SELECT *, {_ERROR} AS error FROM u) SELECT project, count(*) AS total_processed, count(*) FILTER (error IS NULL) AS success_count, count(error) AS error_count, sha256(string_agg(DISTINCT fingerprint || ': ' || error, ';' ORDER BY fingerprint || ': ' || error)) AS errors FROM e GROUP BY project", "stored_findings", "baseline_status",
)
query(
    "mut_05_removed",
    lambda v: gov.removed(v.baseline_status, v.stored_findings.where("severity = 'Critical'").withColumn("project", F.lit(PROJECT)), ["project", "fingerprint"]),
    f"SELECT * FROM baseline_status WHERE NOT (project = '{PROJECT}' AND fingerprint IN (SELECT fingerprint FROM stored_findings WHERE severity = "
    "'Critical'))",
    "baseline_status",
    "stored_findings",
)
query(
    "mut_06_retention",
    lambda v: gov.retention(v.analyses, lit_time("1998-06-30 00:00:00")).groupBy("decision").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN age > 365 THEN 'delete' WHEN age > 90 OR q THEN 'archive' ELSE 'keep' END AS decision, count(*) AS n FROM (SELECT date_diff('day', "
    "ts::DATE, DATE '1998-06-30') AS age, ts::DATE = date_trunc('quarter', ts)::DATE AS q FROM analyses) GROUP BY 1",
    "analyses",
)
query(
    "mut_07_cache_expiry",
    lambda v: v.analyses.select("analysis_id", (F.col("ts") + F.make_dt_interval(F.lit(7)) > lit_time("1997-01-01 00:00:00")).alias("live")).groupBy("live").agg(F.count("*").alias("n")),
    "SELECT ts + INTERVAL 7 DAY > TIMESTAMP '1997-01-01' AS live, count(*) AS n FROM analyses GROUP BY 1",
    "analyses",
)
query(
    "agg_38_cache_statistics",
    lambda v: v.analyses.agg(F.count("*").alias("entries"), F.count_if(F.col("ts") + F.make_dt_interval(F.lit(7)) <= lit_time("1997-01-01 00:00:00")).alias("expired"), F.round(F.avg((F.col("duration_ms") < 200).cast("double")), 6).alias("hit_rate")),
    "SELECT count(*) AS entries, count(*) FILTER (ts + INTERVAL 7 DAY <= TIMESTAMP '1997-01-01') AS expired, round(avg((duration_ms < 200)::INT), 6) AS "
    "hit_rate FROM analyses",
    "analyses",
)
_VERSION = "CASE WHEN start_line = 1 THEN '3.2.0' WHEN start_line = 2 THEN '3.2.7' ELSE '3.3.0' END"
query(
    "mut_08_migrated",
    lambda v: v.facts.select("fact_id", F.expr(_VERSION).alias("version")).select("fact_id", gov.migrated("version").alias("version")),
    "SELECT fact_id, '3.3.0' AS version FROM facts",
    "facts",
)

# Functions.
query(
    "fn_01_text_conditions",
    lambda v: v.facts.select("fact_id", F.col("message").contains("1").alias("has"), F.col("file").rlike("[02468]$").alias("even")),
    "SELECT fact_id, contains(message, '1') AS has, regexp_matches(file, '[02468]$') AS even FROM facts",
    "facts",
)
query(
    "fn_02_allowed_functions",
    lambda v: v.facts.agg(F.count_if(F.col("file").startswith("order/1")).alias("starts"), F.count_if(F.col("file").endswith("9")).alias("ends"), F.count("severity").alias("present")),
    "SELECT count(*) FILTER (starts_with(file, 'order/1')) AS starts, count(*) FILTER (ends_with(file, '9')) AS ends, count(severity) AS present FROM facts",
    "facts",
)
query(
    "fn_03_lengths",
    lambda v: v.facts.where((F.length("file") > 9) & (F.length("message") < 13)).select("fact_id"),
    "SELECT fact_id FROM facts WHERE length(file) > 9 AND length(message) < 13",
    "facts",
)
query(
    "fn_06_metavariables",
    lambda v: v.facts.select("fact_id", F.array_join(tx.metavariables(F.concat(F.lit("call($"), "var", F.lit(", $other)"))), ",").alias("names")),
    "SELECT fact_id, var || ',other' AS names FROM facts",
    "facts",
)
query(
    "fn_07_relative_path",
    lambda v: v.facts.select("fact_id", tx.relative(F.concat(F.lit("/work/app/"), "file"), "/work/app").alias("path")),
    "SELECT fact_id, file AS path FROM facts",
    "facts",
)
query(
    "fn_08_identifiers",
    lambda v: v.facts.select("fact_id", tx.cwe(F.col("cwe_id")).alias("cwe"), tx.cve(F.concat(F.lit("CVE-2024-"), F.col("start_line").cast("string"))).alias("cve")),
    "SELECT fact_id, substr(cwe_id, 5)::INT AS cwe, 'CVE-2024-' || lpad(start_line::VARCHAR, 7, '0') AS cve FROM facts",
    "facts",
)
query(
    "fn_10_clamp",
    lambda v: v.facts.select("fact_id", F.round(F.least(F.greatest(F.col("lines_of_code") / 10 - 1, F.lit(0.0)), F.lit(1.0)), 6).alias("x")),
    "SELECT fact_id, round(least(greatest(lines_of_code / 10.0 - 1, 0), 1)::DOUBLE, 6) AS x FROM facts",
    "facts",
)
query(
    "fn_11_distance",
    lambda v: rules.location_join(v.facts, "Vulnerability", "UncoveredLine", ("fact_id", "end_line")).select("left_fact_id", F.abs(F.col("left_end_line") - F.col("right_end_line")).alias("lines")),
    "SELECT a.fact_id AS left_fact_id, abs(a.end_line - b.end_line) AS lines FROM facts a JOIN facts b ON a.file = b.file AND a.start_line = b.start_line "
    "WHERE a.fact_type = 'Vulnerability' AND b.fact_type = 'UncoveredLine'",
    "facts",
)
query(
    "fn_12_days",
    lambda v: v.analyses.where((F.col("ts") >= _now() - F.make_dt_interval(F.lit(900)))).select("analysis_id", F.datediff(_now(), "ts").alias("days")),
    f"SELECT analysis_id, date_diff('day', ts::DATE, {_T}::DATE)::INT AS days FROM analyses WHERE ts >= {_T} - INTERVAL 900 DAY",
    "analyses",
)
query(
    "fn_14_age",
    lambda v: v.facts.where(F.datediff(_now(), "extracted_at") > 1500).select("fact_id"),
    f"SELECT fact_id FROM facts WHERE date_diff('day', extracted_at::DATE, {_T}::DATE) > 1500",
    "facts",
)
query(
    "fn_15_arrays",
    lambda v: v.facts.select("fact_id", F.split("flow_id", "-").alias("a")).select("fact_id", F.exists("a", lambda x: x == "7").alias("any"), F.element_at("a", 1).alias("first")),
    "SELECT fact_id, list_contains(string_split(flow_id, '-'), '7') AS any, string_split(flow_id, '-')[1] AS first FROM facts",
    "facts",
)
query(
    "fn_16_map_default",
    lambda v: v.facts.select("fact_id", F.coalesce(F.try_element_at(F.create_map("extractor", "severity"), F.lit("linter")), F.lit("unknown")).alias("s")),
    "SELECT fact_id, CASE WHEN extractor = 'linter' THEN coalesce(severity, 'unknown') ELSE 'unknown' END AS s FROM facts",
    "facts",
)
query(
    "fn_17_value_types",
    lambda v: v.custom.select("event_id", dynamic.value_type(F.col("data")).alias("whole"), dynamic.value_type(F.get_json_object("data", "$.k")).alias("field")),
    "SELECT event_id, 'object' AS whole, 'number' AS field FROM custom",
    "custom",
)
query(
    "fn_19_ranks",
    lambda v: v.facts.select("fact_id", sev.mapped("severity", sev.IR_RANK).alias("rank"), sev.mapped(sev.published("severity"), sev.SERVER_RANK).alias("server_rank")),
    f"SELECT fact_id, {sev.sql_case('severity', sev.IR_RANK)} AS rank, {sev.sql_case('''replace(severity, 'Blocker', 'Critical')''', sev.SERVER_RANK)} AS "
    "server_rank FROM facts",
    "facts",
)
query(
    "fn_20_coverage_bands",
    lambda v: v.coverage.groupBy(sev.coverage_band(F.col("line_coverage")).alias("band")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN line_coverage < 50 THEN 'low' WHEN line_coverage <= 80 THEN 'acceptable' ELSE 'excellent' END AS band, count(*) AS n FROM coverage "
    "GROUP BY 1",
    "coverage",
)
query(
    "fn_21_complexity_levels",
    lambda v: v.coverage.groupBy(sev.complexity_level(F.col("line_coverage")).alias("level")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN line_coverage < 20 THEN 'Low' WHEN line_coverage < 50 THEN 'Medium' WHEN line_coverage < 80 THEN 'High' ELSE 'Critical' END AS "
    "level, count(*) AS n FROM coverage GROUP BY 1",
    "coverage",
)
query(
    "fn_22_number_text",
    lambda v: v.facts.select("fact_id", tx.number_text(F.col("lines_of_code") / 2).alias("half"), F.format_string("%.2f", "confidence").alias("sure")),
    "SELECT fact_id, CASE WHEN lines_of_code % 2 = 0 THEN (lines_of_code // 2)::VARCHAR ELSE (lines_of_code / 2)::VARCHAR END AS half, printf('%.2f', "
    "confidence) AS sure FROM facts",
    "facts",
)
query(
    "rem_31_exit_code",
    lambda v: v.facts.agg(F.max(sev.mapped("severity", sev.EXIT_CODE)).alias("code")),
    f"SELECT max({sev.sql_case('severity', sev.EXIT_CODE)}) AS code FROM facts",
    "facts",
)
