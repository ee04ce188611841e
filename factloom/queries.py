"""Registered queries: one for each operator of the survey's inventory, by its id, over the views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import shared_path
from factloom.functions import severity as sev
from factloom.functions import text as tx
from factloom.operators import governance as gov
from factloom.operators import graph, quality, rules, store
from factloom.sources.views import NOW, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_STORES: dict[tuple[str, str, str], str] = {}

#: Parameters that queries and oracles share.
BRANCHES = ("1-URGENT", "2-HIGH")
PROJECT = "project-3"
SPAN = ("1995-01-01 00:00:00", "1996-12-31 00:00:00")
POLICY = {"source": ["param", "file"], "sink": ["query", "xss"], "sanitizer": ["escape"]}
REPORTED = "'Vulnerability', 'CodeSmell'"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    @property
    def store(self) -> DataFrame:
        """The facts as a stored table, by type and place. It is written once for each session and folder of tables."""
        facts = self.facts
        return store.opened(self.spark, self.stored("facts", lambda path: store.written_by_type(facts, path)), facts.schema)

    def stored(self, name: str, write: Callable[[str], None]) -> str:
        """Where write(path) has put a table; it runs once for each session and folder of tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORES:
            path = shared_path(self.spark, name)
            write(path)
            _STORES[key] = path
        return _STORES[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, run: Callable[[Views], DataFrame], sql: str | None = None, *views: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir))
    if sql is not None:
        _SQL[name] = with_views("\n" + sql, *views)


def queries() -> dict[str, Query]:
    from factloom import deep_queries, more_queries, source_queries, stored_queries, whole_queries  # noqa: F401  (they register themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from factloom import deep_queries, more_queries, source_queries, stored_queries, whole_queries  # noqa: F401

    return dict(_SQL)


def lit_time(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _now():
    return lit_time(NOW)


_T = f"TIMESTAMP '{NOW}'"

# Scans of the store.
query(
    "src_01_all_facts",
    lambda v: v.facts.select("fact_id", "fact_type", "file", "start_line", "end_line", "severity", "confidence"),
    "SELECT fact_id, fact_type, file, start_line, end_line, severity, confidence FROM facts",
    "facts",
)
query("src_02_fact_count", lambda v: v.facts.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM facts", "facts")
query(
    "src_03_by_type",
    lambda v: store.by_type(v.store, "Vulnerability").select("fact_id", "file", "start_line", "severity"),
    "SELECT fact_id, file, start_line, severity FROM facts WHERE fact_type = 'Vulnerability'",
    "facts",
)
query("src_04_type_counts", lambda v: store.type_counts(v.store).select("fact_type", "n"), "SELECT fact_type, count(*) AS n FROM facts GROUP BY 1", "facts")
query("src_05_by_file", lambda v: store.by_file(v.store, "order/7").select("fact_id", "start_line"), "SELECT fact_id, start_line FROM facts WHERE file = 'order/7'", "facts")
query(
    "src_06_by_location",
    lambda v: store.by_location(v.store, "order/5", 2, 4).select("fact_id", "start_line", "end_line"),
    "SELECT fact_id, start_line, end_line FROM facts WHERE file = 'order/5' AND start_line <= 4 AND end_line >= 2",
    "facts",
)
query("src_07_by_flow", lambda v: store.by_flow(v.store, "flow-7").select("fact_id", "fact_type"), "SELECT fact_id, fact_type FROM facts WHERE flow_id = 'flow-7'", "facts")
query(
    "src_08_types_of_files",
    lambda v: v.store.groupBy("file").pivot("fact_type", ["Vulnerability", "UncoveredLine", "CodeSmell"]).count().na.fill(0),
    "SELECT file, count(*) FILTER (fact_type = 'Vulnerability') AS \"Vulnerability\", count(*) FILTER (fact_type = 'UncoveredLine') AS \"UncoveredLine\", "
    "count(*) FILTER (fact_type = 'CodeSmell') AS \"CodeSmell\" FROM facts GROUP BY file",
    "facts",
)
query(
    "src_23_fact_at_index",
    lambda v: store.at_index(v.facts, ["fact_id"], 41).select("fact_id", "fact_type", "file"),
    "SELECT fact_id, fact_type, file FROM facts ORDER BY fact_id LIMIT 1 OFFSET 41",
    "facts",
)
query(
    "flt_23_matching",
    lambda v: store.matching(v.store, "Vulnerability", severity="Critical", extractor="linter").select("fact_id", "file"),
    "SELECT fact_id, file FROM facts WHERE fact_type = 'Vulnerability' AND severity = 'Critical' AND extractor = 'linter'",
    "facts",
)
query("agg_04_index_statistics", lambda v: store.type_counts(v.store), "SELECT fact_type, count(*) AS n, count(*) * 64 AS bytes FROM facts GROUP BY 1", "facts")
query(
    "agg_05_file_statistics",
    lambda v: store.file_statistics(v.facts),
    "SELECT file, count(*) AS n, min(start_line) AS first_line, max(end_line) AS last_line, round(count(*)::DOUBLE / (max(end_line) - min(start_line) + "
    "1), 6) AS density FROM facts GROUP BY file",
    "facts",
)
query("agg_06_flow_statistics", lambda v: store.flow_statistics(v.facts), "SELECT flow_id, count(*) AS n FROM facts WHERE flow_id IS NOT NULL GROUP BY 1", "facts")
query(
    "flt_22_duplicate_ids",
    lambda v: store.duplicate_ids(v.facts.union(v.facts.where("start_line = 3"))),
    "SELECT fact_id, count(*) AS n FROM (SELECT fact_id FROM facts UNION ALL SELECT fact_id FROM facts WHERE start_line = 3) GROUP BY 1 HAVING count(*) > 1",
    "facts",
)
query(
    "agg_40_interned",
    lambda v: store.interned(v.facts, "message"),
    "SELECT message AS value, row_number() OVER (ORDER BY message) - 1 AS id FROM (SELECT DISTINCT message FROM facts)",
    "facts",
)
query(
    "agg_35_full_type_counts",
    lambda v: v.facts.groupBy("fact_type", "severity", "message").agg(F.count("*").alias("n")),
    "SELECT fact_type, severity, message, count(*) AS n FROM facts GROUP BY ALL",
    "facts",
)
query(
    "agg_36_count_difference",
    lambda v: v.facts.agg(F.abs(F.count_if(F.col("extractor") == "linter") - F.count_if(F.col("extractor") == "reports")).alias("difference")),
    "SELECT abs(count(*) FILTER (extractor = 'linter') - count(*) FILTER (extractor = 'reports')) AS difference FROM facts",
    "facts",
)

# Projections.
_PREFIX = {"Vulnerability": "Security vulnerability", "CodeSmell": "Code smell detected", "UncoveredLine": "Uncovered line"}
query(
    "prj_01_default_message",
    lambda v: v.facts.select("fact_id", F.when(F.col("fact_type") == "Vulnerability", F.col("message")).otherwise(sev.mapped("fact_type", _PREFIX, "")).alias("text")),
    f"SELECT fact_id, CASE WHEN fact_type = 'Vulnerability' THEN message ELSE {sev.sql_case('fact_type', _PREFIX)} END AS text FROM facts",
    "facts",
)
query(
    "prj_02_own_message",
    lambda v: v.facts.select("fact_id", F.concat(F.lit("note: "), "message").alias("message")),
    "SELECT fact_id, 'note: ' || message AS message FROM facts",
    "facts",
)
query(
    "prj_03_custom_field",
    lambda v: v.custom.select("event_id", F.try_variant_get(F.try_parse_json("data"), "$.k", "int").alias("k")),
    "SELECT event_id, (data->>'$.k')::INT AS k FROM custom",
    "custom",
)
query(
    "prj_04_location_text",
    lambda v: v.facts.select("fact_id", tx.location_text().alias("place")),
    "SELECT fact_id, file || ':' || start_line || CASE WHEN start_column IS NULL THEN '' ELSE ':' || start_column END || '-' || end_line AS place FROM "
    "facts",
    "facts",
)
query(
    "prj_05_template",
    lambda v: v.facts.withColumn("metadata", F.create_map(F.lit("flow"), "flow_id")).select("fact_id", tx.template("{fact.type} ({fact.confidence}) at {location.file}:{location.start_line} of {metadata.flow}, {metadata.owner}").alias("text")),
    "SELECT fact_id, fact_type || ' (' || printf('%.2f', confidence) || ') at ' || file || ':' || start_line || ' of ' || flow_id || ', unknown' AS text "
    "FROM facts",
    "facts",
)
_FINDING = "sha256('uncovered-weakness|' || fact_id) AS finding_id, 'uncovered-weakness' AS rule_name, fact_type || ' in ' || file AS message, file, start_line, end_line, confidence, severity"


def _found(facts: DataFrame) -> DataFrame:
    return rules.findings(facts, "uncovered-weakness", "{fact.type} in {location.file}", F.col("severity"), F.col("confidence"))


query(
    "prj_06_findings",
    lambda v: _found(v.facts.where("fact_type = 'Vulnerability'")).drop("metadata", "fact_ids"),
    f"SELECT {_FINDING} FROM facts WHERE fact_type = 'Vulnerability'",
    "facts",
)
query(
    "rule_location_findings",
    lambda v: _found(rules.exists_all(v.store, "Vulnerability", "UncoveredLine")).drop("metadata", "fact_ids"),
    f"SELECT {_FINDING} FROM facts f WHERE fact_type = 'Vulnerability' AND EXISTS (SELECT 1 FROM facts u WHERE u.fact_type = 'UncoveredLine' AND u.file = "
    "f.file AND u.start_line = f.start_line)",
    "facts",
)

# Predicates.
query("flt_01_type_name", lambda v: v.facts.where(F.col("fact_type") == "CodeSmell").select("fact_id"), "SELECT fact_id FROM facts WHERE fact_type = 'CodeSmell'", "facts")
query(
    "flt_02_custom_pattern",
    lambda v: store.by_custom(v.custom, tx.glob("discriminant", "events:*c*")).select("event_id", "discriminant"),
    "SELECT event_id, discriminant FROM custom WHERE discriminant LIKE 'events:%c%'",
    "custom",
)
query("flt_03_glob", lambda v: v.facts.where(tx.glob("file", "order/?2*")).select("fact_id", "file"), "SELECT fact_id, file FROM facts WHERE file LIKE 'order/_2%'", "facts")
query(
    "flt_04_conditions",
    lambda v: quality.filtered(v.facts, [("severity", "==", "Major"), ("message", "contains", "ess 1"), ("file", "matches", "7$"), ("extractor", "!=", "linter")]).select("fact_id"),
    "SELECT fact_id FROM facts WHERE severity = 'Major' AND contains(message, 'ess 1') AND regexp_matches(file, '7$') AND extractor <> 'linter'",
    "facts",
)
query(
    "flt_05_more_operators",
    lambda v: quality.filtered(v.facts, [("confidence", ">", 0.95), ("lines_of_code", "<", 20), ("file", "=~", "/1"), ("message", "!~", "1$")]).select("fact_id"),
    "SELECT fact_id FROM facts WHERE confidence > 0.95 AND lines_of_code < 20 AND regexp_matches(file, '/1') AND NOT regexp_matches(message, '1$')",
    "facts",
)
query(
    "flt_06_truth",
    lambda v: v.custom.where(F.coalesce(F.try_variant_get(F.try_parse_json("data"), "$.k", "double") > 0, F.lit(False))).select("event_id"),
    "SELECT event_id FROM custom WHERE coalesce((data->>'$.k')::DOUBLE > 0, FALSE)",
    "custom",
)
query(
    "flt_07_field_exists",
    lambda v: v.custom.where((F.col("discriminant") == "events:click") & F.try_variant_get(F.try_parse_json("data"), "$.k", "variant").isNotNull()).select("event_id"),
    "SELECT event_id FROM custom WHERE discriminant = 'events:click' AND json_exists(data, '$.k')",
    "custom",
)
query(
    "flt_08_and_or",
    lambda v: v.facts.where(((F.col("severity") == "Critical") | (F.col("severity") == "Blocker")) & (F.col("start_line") > 2)).select("fact_id"),
    "SELECT fact_id FROM facts WHERE (severity = 'Critical' OR severity = 'Blocker') AND start_line > 2",
    "facts",
)
query(
    "flt_09_text_compare",
    lambda v: v.facts.where(tx.number_text(F.col("lines_of_code").cast("double")) > "30").select("fact_id"),
    "SELECT fact_id FROM facts WHERE lines_of_code::VARCHAR > '30'",
    "facts",
)
query(
    "flt_10_value_text",
    lambda v: v.custom.select("event_id", F.try_parse_json("data").cast("map<string,int>")["k"].cast("string").alias("text")),
    "SELECT event_id, data->>'$.k' AS text FROM custom",
    "custom",
)
query(
    "flt_11_reachable",
    lambda v: graph.flows_to_sink(v.flows).select("flow_id").distinct(),
    "SELECT DISTINCT a.flow_id FROM flows a JOIN flows b USING (flow_id) WHERE a.fact_type = 'TaintSource' AND b.fact_type = 'TaintSink'",
    "flows",
)
query(
    "flt_15_metric_filter",
    lambda v: quality.aggregate(quality.filtered(v.facts, [("severity", "==", "Minor"), ("confidence", ">=", 0.95)]), "count"),
    "SELECT count(*)::DOUBLE AS value FROM facts WHERE severity = 'Minor' AND confidence >= 0.95",
    "facts",
)
query(
    "flt_16_condition_tree",
    lambda v: v.facts.where(~((F.coalesce(F.col("severity"), F.lit("")) == "Info") | (F.col("confidence") < 0.95)) & F.col("start_column").isNotNull()).select("fact_id"),
    "SELECT fact_id FROM facts WHERE NOT (coalesce(severity, '') = 'Info' OR confidence < 0.95) AND start_column IS NOT NULL",
    "facts",
)
query(
    "flt_17_substring",
    lambda v: v.facts.where(F.lower(F.concat_ws(" ", "fact_type", "message")).contains("smell 1")).select("fact_id"),
    "SELECT fact_id FROM facts WHERE contains(lower(fact_type || ' ' || message), 'smell 1')",
    "facts",
)
query(
    "flt_20_publish_violations",
    lambda v: v.analyses.join(v.stored_findings.groupBy("analysis_id").agg(F.count("*").alias("findings")), "analysis_id", "left").withColumn("branch", F.when(F.col("analysis_id") % 9 == 0, "").otherwise(F.col("branch"))).select("analysis_id", F.array_join(gov.publish_violations(), "; ").alias("violations")),
    "SELECT o_orderkey AS analysis_id, CASE WHEN o_orderkey % 9 = 0 THEN 'branch is empty' ELSE '' END AS violations FROM orders",
)
query(
    "flt_21_custom_schema",
    lambda v: _schema_violations(v),
    "SELECT event_id, CASE WHEN discriminant = 'events:click' THEN 'missing field: target' ELSE '' END AS violations FROM custom",
    "custom",
)


def _schema_violations(v: Views) -> DataFrame:
    from factloom.functions.dynamic import Registry

    known = Registry()
    known.register("events:", "1", {"k": ("number", True)})
    known.register("events:click", "1", {"k": ("number", True), "target": ("string", True)})
    return v.custom.select("event_id", F.array_join(known.violations(F.col("discriminant"), F.col("data")), "; ").alias("violations"))


# Joins.
query(
    "join_01_match_union",
    lambda v: rules.match_union(v.facts, "Vulnerability", "CodeSmell").select("fact_id", "fact_type"),
    f"SELECT DISTINCT fact_id, fact_type FROM facts WHERE fact_type IN ({REPORTED})",
    "facts",
)
query(
    "join_02_match_join",
    lambda v: rules.match_join(v.facts, "Vulnerability", "CodeSmell", (F.col("left_file") == F.col("right_file")) & (F.col("left_start_line") < F.col("right_start_line")) & (F.col("left_severity") == "Critical"), ["file", "start_line", "severity", "fact_id"]).select("left_fact_id", "right_fact_id"),
    "SELECT a.fact_id AS left_fact_id, b.fact_id AS right_fact_id FROM facts a JOIN facts b ON a.file = b.file AND a.start_line < b.start_line WHERE "
    "a.fact_type = 'Vulnerability' AND b.fact_type = 'CodeSmell' AND a.severity = 'Critical'",
    "facts",
)
query(
    "join_03_location",
    lambda v: rules.location_join(v.store, "Vulnerability", "UncoveredLine"),
    "SELECT a.file, a.start_line, a.fact_id AS left_fact_id, b.fact_id AS right_fact_id FROM facts a JOIN facts b ON a.file = b.file AND a.start_line = "
    "b.start_line WHERE a.fact_type = 'Vulnerability' AND b.fact_type = 'UncoveredLine'",
    "facts",
)
query(
    "join_04_overlap",
    lambda v: rules.overlap_join(v.store, "Vulnerability", "UncoveredLine"),
    "SELECT a.file, a.fact_id AS left_fact_id, b.fact_id AS right_fact_id FROM facts a JOIN facts b ON a.file = b.file AND a.start_line <= b.end_line AND "
    "b.start_line <= a.end_line WHERE a.fact_type = 'Vulnerability' AND b.fact_type = 'UncoveredLine'",
    "facts",
)
query(
    "join_05_flow_pairs",
    lambda v: rules.flow_pair_counts(v.flows),
    "SELECT flow_id, sources, sinks, sources * sinks AS pairs FROM (SELECT flow_id, count(*) FILTER (fact_type = 'TaintSource') AS sources, count(*) "
    "FILTER (fact_type = 'TaintSink') AS sinks FROM flows GROUP BY 1) WHERE sources > 0 AND sinks > 0",
    "flows",
)
query(
    "join_06_shared_variables",
    lambda v: rules.exists_all(v.store, "Vulnerability", "UncoveredLine", "CodeSmell").select("fact_id"),
    "SELECT fact_id FROM facts f WHERE fact_type = 'Vulnerability' AND EXISTS (SELECT 1 FROM facts u WHERE u.fact_type = 'UncoveredLine' AND u.file = "
    "f.file AND u.start_line = f.start_line) AND EXISTS (SELECT 1 FROM facts u WHERE u.fact_type = 'CodeSmell' AND u.file = f.file AND u.start_line = "
    "f.start_line)",
    "facts",
)
query(
    "join_07_owners",
    lambda v: rules.owners(v.facts.withColumn("file", F.concat(F.lit("src/"), "extractor", F.lit("/"), "file")), v.spark.createDataFrame([("src", "all"), ("src/linter", "lint team"), ("src/reports/order", "order team")], "prefix string, owner string")).select("fact_id", "owner"),
    "SELECT fact_id, owner FROM (SELECT fact_id, 'src/' || extractor || '/' || file AS path FROM facts) JOIN (VALUES ('src', 'all'), ('src/linter', 'lint "
    "team'), ('src/reports/order', 'order team')) o(prefix, owner) ON starts_with(path, prefix || '/')",
    "facts",
)
_TAINT = "t AS (SELECT DISTINCT flow_id FROM flows WHERE fact_type = 'TaintSource'), s AS (SELECT DISTINCT flow_id, func FROM flows WHERE fact_type = 'TaintSink' AND flow_id IN (SELECT flow_id FROM t)), c AS (SELECT DISTINCT flow_id FROM flows WHERE fact_type = 'Sanitization' AND effective AND flow_id IN (SELECT flow_id FROM t))"
query("join_08_flows_to_sink", lambda v: graph.flows_to_sink(v.flows), f"WITH {_TAINT} SELECT * FROM s", "flows")
query("join_09_sanitized", lambda v: graph.sanitized(v.flows), f"WITH {_TAINT} SELECT * FROM c", "flows")
query(
    "join_10_unsanitized",
    lambda v: graph.unsanitized(v.flows),
    f"WITH {_TAINT} SELECT flow_id, func, (SELECT min(node) FROM flows x WHERE x.flow_id = s.flow_id AND fact_type = 'TaintSource') AS source FROM s WHERE "
    "flow_id NOT IN (SELECT flow_id FROM c)",
    "flows",
)
query(
    "join_11_policy",
    lambda v: graph.policy_matches(v.flows, POLICY),
    "SELECT flow_id, node, role, pattern FROM flows JOIN (VALUES ('source', 'param'), ('source', 'file'), ('sink', 'query'), ('sink', 'xss'), "
    "('sanitizer', 'escape')) p(role, pattern) ON (role = 'source' AND fact_type = 'TaintSource' AND contains(var, pattern)) OR (role = 'sink' AND "
    "fact_type = 'TaintSink' AND (contains(func, pattern) OR contains(category, pattern))) OR (role = 'sanitizer' AND fact_type = 'Sanitization' AND "
    "contains(method, pattern))",
    "flows",
)
query("graph_05_tainted", lambda v: graph.tainted(v.flows), "SELECT DISTINCT flow_id FROM flows WHERE fact_type = 'TaintSource'", "flows")
query(
    "join_12_policy_paths",
    lambda v: _policy_paths(v),
    "SELECT DISTINCT flow_id FROM flows a JOIN flows b USING (flow_id) WHERE a.fact_type = 'TaintSource' AND (contains(a.var, 'param') OR contains(a.var, "
    "'file')) AND b.fact_type = 'TaintSink' AND (contains(b.func, 'query') OR contains(b.category, 'xss') OR contains(b.category, 'query') OR "
    "contains(b.func, 'xss'))",
    "flows",
)


def _policy_paths(v: Views) -> DataFrame:
    met = graph.policy_matches(v.flows, POLICY)
    return met.where("role = 'source'").select("flow_id").distinct().join(met.where("role = 'sink'").select("flow_id"), "flow_id", "left_semi")


_LITERAL = "cast(lines_of_code AS varchar)"
query(
    "graph_08_connascence", lambda v: graph.all_connascence(v.facts.select(F.col("file").alias("entity"), "var", F.col("message").alias("type"), F.col("lines_of_code").cast("string").alias("literal")), v.facts.select(F.col("file").alias("entity"), F.col("start_line").alias("place"), F.col("fact_type").alias("type"), F.coalesce("severity", F.lit("none")).alias("step"))),
    " UNION ALL ".join(f"SELECT '{kind}' AS kind, {c} AS shared, count(DISTINCT file) AS entities, count(*) AS frequency FROM facts GROUP BY {c} HAVING count(DISTINCT file) > 1" for kind, c in (("Name", "var"), ("Type", "message"), ("Meaning", _LITERAL)))
    + "".join(f" UNION ALL SELECT '{kind}', s, count(*), count(*) FROM (SELECT file, string_agg({c}, ',' ORDER BY start_line, {c}) AS s FROM facts GROUP BY file HAVING count(*) >= 3) GROUP BY s HAVING count(*) > 1" for kind, c in (("Position", "fact_type"), ("Algorithm", "coalesce(severity, 'none')"))), "facts",
)
_KINDS = "CASE l_suppkey % 5 WHEN 0 THEN 'Name' WHEN 1 THEN 'Type' WHEN 2 THEN 'Meaning' WHEN 3 THEN 'Position' ELSE 'Algorithm' END"


def _strengths(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.expr(_KINDS).alias("kind"), (F.col("l_partkey") % 14).cast("int").alias("entities"), F.col("l_quantity").cast("int").alias("frequency")).distinct()
    return rows.withColumn("strength", graph.strength(F.col("kind"), F.col("entities"), F.col("frequency")))


_STRENGTH_SQL = f"WITH r AS (SELECT DISTINCT {_KINDS} AS kind, (l_partkey % 14)::INT AS entities, l_quantity::INT AS frequency FROM lineitem), b AS (SELECT *, CASE WHEN entities <= 1 THEN 1 WHEN entities <= 3 THEN 2 WHEN entities <= 6 THEN 3 WHEN entities <= 10 THEN 4 ELSE 5 END AS base FROM r), k AS (SELECT *, CASE WHEN kind IN ('Algorithm', 'Meaning') AND base IN (2, 3) THEN base + 1 WHEN kind IN ('Name', 'Position') AND base = 5 THEN 4 ELSE base END AS s FROM b) SELECT kind, entities, frequency, CASE WHEN frequency > 10 AND s BETWEEN 2 AND 4 THEN s + 1 ELSE s END AS strength FROM k"
query("graph_09_strength", _strengths, _STRENGTH_SQL)
query("graph_10_strong_enough", lambda v: _strengths(v).where("strength >= 2"), f"SELECT * FROM ({_STRENGTH_SQL}) WHERE strength >= 2")

# Diffs and baselines.
_LAST = "(SELECT analysis_id FROM analyses WHERE project = '{0}' AND branch = '{1}' ORDER BY ts DESC, analysis_id DESC LIMIT 1)"
_CHANGE = "SELECT 'new' AS change, fingerprint, file, line, severity FROM head WHERE fingerprint NOT IN (SELECT fingerprint FROM base) UNION ALL SELECT 'resolved', fingerprint, file, line, severity FROM base WHERE fingerprint NOT IN (SELECT fingerprint FROM head) UNION ALL SELECT CASE WHEN steps > 0 THEN 'increased' ELSE 'decreased' END, fingerprint, file, line, severity FROM ranked WHERE steps <> 0"
query(
    "join_17_branch_diff",
    lambda v: gov.new_findings(*[gov.branch_findings(v.analyses, v.stored_findings, PROJECT, b) for b in BRANCHES]).select("fingerprint", "file", "line"),
    f"SELECT fingerprint, file, line FROM stored_findings WHERE analysis_id = {_LAST.format(PROJECT, BRANCHES[1])} AND fingerprint NOT IN (SELECT "
    f"fingerprint FROM stored_findings WHERE analysis_id = {_LAST.format(PROJECT, BRANCHES[0])})",
    "analyses",
    "stored_findings",
)
query(
    "join_18_commit_diff",
    lambda v: gov.new_findings(*[v.stored_findings.join(v.analyses.where(F.col("commit_id") == c), "analysis_id", "left_semi") for c in ("c1", "c2")]).select("fingerprint", "file", "line"),
    "SELECT fingerprint, file, line FROM stored_findings WHERE analysis_id IN (SELECT analysis_id FROM analyses WHERE commit_id = 'c2') AND fingerprint "
    "NOT IN (SELECT fingerprint FROM stored_findings WHERE analysis_id IN (SELECT analysis_id FROM analyses WHERE commit_id = 'c1'))",
    "analyses",
    "stored_findings",
)
query(
    "join_19_without_baseline",
    lambda v: gov.without_baseline(v.stored_findings, v.baseline_status, PROJECT, _now()).select("fingerprint", "file", "line"),
    f"SELECT fingerprint, file, line FROM stored_findings WHERE fingerprint NOT IN (SELECT fingerprint FROM baseline_status WHERE project = '{PROJECT}' AND "
    f"(expires_at IS NULL OR expires_at >= {_T}))",
    "stored_findings",
    "baseline_status",
)
query(
    "join_20_in_baseline",
    lambda v: gov.in_baseline(v.stored_findings, v.baseline_status, PROJECT, _now()).select("fingerprint", "file", "line"),
    f"SELECT fingerprint, file, line FROM stored_findings WHERE fingerprint IN (SELECT fingerprint FROM baseline_status WHERE project = '{PROJECT}' AND "
    f"(expires_at IS NULL OR expires_at > {_T}))",
    "stored_findings",
    "baseline_status",
)
query(
    "join_21_trend_join",
    lambda v: v.stored_findings.join(v.analyses, "analysis_id").groupBy("project", "branch").agg(F.count("*").alias("n")),
    "SELECT project, branch, count(*) AS n FROM stored_findings JOIN analyses USING (analysis_id) GROUP BY ALL",
    "analyses",
    "stored_findings",
)
_SUMMARY = "SELECT project, count(DISTINCT a.analysis_id) AS analyses, count(f.analysis_id) AS findings, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Major') AS major, count(*) FILTER (severity = 'Minor') AS minor, count(*) FILTER (severity = 'Info') AS info, min(ts) AS first_ts, max(ts) AS last_ts FROM analyses a LEFT JOIN stored_findings f USING (analysis_id) GROUP BY project"
query("join_22_project_summary", lambda v: gov.project_summary(v.analyses, v.stored_findings), _SUMMARY, "analyses", "stored_findings")
query(
    "agg_24_project_statistics",
    lambda v: gov.project_summary(v.analyses, v.stored_findings).select("project", "analyses", "findings", "critical", "first_ts", "last_ts"),
    f"SELECT project, analyses, findings, critical, first_ts, last_ts FROM ({_SUMMARY})",
    "analyses",
    "stored_findings",
)
