"""Registered queries of sources, the rule language and streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import severity as sev
from factloom.functions.text import duration_ms
from factloom.operators import model, quality
from factloom.plans import rulebook
from factloom.queries import Views, query
from factloom.sources import reports, texts
from factloom.streaming import fanned_out, publish, rate_limited, read_events, received, requests_per_minute

# Reports, one result each, from the driver's rows; the same choices as SQL text.
_RULE = "CASE l_partkey % 5 WHEN 0 THEN 'S100' WHEN 1 THEN 'sql-security' WHEN 2 THEN 'layout-1' WHEN 3 THEN 'CWE-rule' ELSE 'x-vulnerability' END"
_LEVEL = "CASE WHEN l_returnflag = 'A' THEN 'error' WHEN l_returnflag = 'R' THEN 'warning' WHEN l_linestatus = 'O' THEN 'note' END"
_SEVERITY = "CASE l_suppkey % 4 WHEN 0 THEN l_quantity / 4 END"
_FILE = "'src/f' || cast(l_suppkey AS {text}) || '.py'"


def _reports(v: Views, complete: bool = False) -> DataFrame:
    region = F.expr(f"CASE WHEN {complete} OR l_suppkey % 10 <> 0 THEN named_struct('startLine', l_linenumber, 'startColumn', cast(l_suppkey % 3 AS int), 'endLine', CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 2 END, 'endColumn', cast(NULL AS int)) END")
    place = F.struct(F.struct(F.struct(F.expr(_FILE.format(text="string")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = F.struct(F.parse_json(F.expr(f"cast({_SEVERITY} AS string)")).alias("security-severity"), F.expr("CASE WHEN l_partkey % 3 = 0 THEN array('CWE-' || cast(l_partkey % 90 AS string)) END").alias("cwe"), F.expr("CASE WHEN l_partkey % 7 = 0 THEN array('external/Security') END").alias("tags"), F.lit(None).cast("string").alias("owasp"), F.lit(None).cast("double").alias("cvss"))
    result = F.struct(F.expr(_RULE).alias("ruleId"), F.expr(_LEVEL).alias("level"), F.struct(F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("text")).alias("message"), F.array(place).alias("locations"), props.alias("properties"))
    driver = F.struct(F.struct(F.struct(F.lit("scanner").alias("name"), F.lit("1").alias("version")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    return v.table("lineitem").select(F.array(driver).alias("runs"))


def _report_files(v: Views) -> DataFrame:
    """The reports as files, a report with all results of an order on each line; written once for each session and folder of tables."""

    def write(path: str) -> None:
        r = F.col("runs")[0]
        grouped = _reports(v).groupBy(r["results"][0]["message"]["text"].alias("order")).agg(F.first(r["tool"]).alias("tool"), F.flatten(F.collect_list(r["results"])).alias("results"))
        grouped.select(F.array(F.struct("tool", "results")).alias("runs")).write.option("compression", "gzip").json(path)

    return reports.read_reports(v.spark, v.stored("reports", write), lines=True)


_FACTS = f"""SELECT CASE WHEN l_suppkey % 4 = 0 OR l_partkey % 7 = 0 OR l_partkey % 5 <> 2 THEN 'Vulnerability' ELSE 'CodeSmell' END AS fact_type, {_RULE} AS rule,
  CASE coalesce({_LEVEL}, 'warning') WHEN 'error' THEN 'Critical' WHEN 'warning' THEN 'Major' ELSE 'Minor' END AS severity, 'm' || l_orderkey AS message,
  CASE WHEN l_partkey % 3 = 0 THEN 'CWE-' || (l_partkey % 90) END AS cwe_id, round(CASE WHEN l_suppkey % 4 = 0 THEN least(greatest(l_quantity / 40, 0), 1) ELSE 0.5 END::DOUBLE, 4) AS confidence,
  {_FILE.format(text='varchar')} AS file, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE l_linenumber END AS start_line, CASE WHEN l_suppkey % 10 <> 0 AND l_suppkey % 3 > 0 THEN (l_suppkey % 3)::INT END AS start_column,
  CASE WHEN l_suppkey % 10 = 0 THEN 1 WHEN l_linenumber % 2 = 0 THEN l_linenumber + 2 ELSE l_linenumber END AS end_line, 'scanner' AS extractor FROM lineitem"""
query(
    "src_16_report_files",
    lambda v: reports.results(_report_files(v)).groupBy("tool", "rule").agg(F.count("*").alias("n")),
    f"SELECT 'scanner' AS tool, {_RULE} AS rule, count(*) AS n FROM lineitem GROUP BY ALL",
)
query("src_09_report_facts", lambda v: reports.report_facts(_report_files(v)).drop("owasp_category", "cvss_score", "end_column"), _FACTS)
query(
    "src_10_report_locations",
    lambda v: reports.report_facts(_reports(v)).groupBy("file").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last")),
    f"SELECT file, min(start_line) AS first, max(end_line) AS last FROM ({_FACTS}) GROUP BY 1",
)
query(
    "src_11_report_severity",
    lambda v: reports.report_facts(_reports(v)).groupBy("severity").agg(F.count("*").alias("n")),
    f"SELECT severity, count(*) AS n FROM ({_FACTS}) GROUP BY 1",
)
query(
    "src_12_report_filters",
    lambda v: reports.report_facts(_reports(v), "Major", ("secur", "S1")).select("rule", "severity", "message"),
    f"SELECT rule, severity, message FROM ({_FACTS}) WHERE severity IN ('Critical', 'Major') AND NOT contains(rule, 'secur') AND NOT contains(rule, 'S1')",
)
query(
    "src_13_security_results",
    lambda v: reports.report_facts(_reports(v)).groupBy("rule", "fact_type").agg(F.count("*").alias("n")),
    f"SELECT rule, fact_type, count(*) AS n FROM ({_FACTS}) GROUP BY ALL",
)
query("src_14_report_numbers", lambda v: reports.report_facts(_reports(v)).select("message", "confidence", "cwe_id"), f"SELECT message, confidence, cwe_id FROM ({_FACTS})")
query(
    "src_15_adapter_facts",
    lambda v: reports.adapter_facts(_reports(v, complete=True)),
    "SELECT CASE WHEN l = 'warning' THEN 'CodeSmell' ELSE 'Vulnerability' END AS fact_type, CASE l WHEN 'error' THEN 'Critical' WHEN 'warning' THEN "
    "'Major' ELSE 'Minor' END AS severity, CASE l WHEN 'error' THEN 0.9 WHEN 'warning' THEN NULL ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN l <> "
    f"'warning' THEN {_RULE} END AS cwe_id, 'm' || l_orderkey AS message, {_FILE.format(text='varchar')} AS file, l_linenumber AS start_line FROM (SELECT "
    f"*, coalesce({_LEVEL}, 'warning') AS l FROM lineitem)",
)


def _diagnostics(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.concat(F.lit("/repo/"), F.expr(_FILE.format(text="string"))).alias("filename"), F.concat(F.lit("E"), (F.col("l_partkey") % 500).cast("string")).alias("code"), F.concat(F.lit("text "), F.col("l_orderkey").cast("string")).alias("message"), F.expr("CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'info' END").alias("severity"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 80 + 1).cast("int").alias("column"), F.expr("CASE WHEN l_linenumber > 3 THEN l_linenumber + 1 END").alias("endLine"))


query(
    "src_17_linter_facts",
    lambda v: reports.linter_facts(_diagnostics(v), "/repo"),
    "SELECT 'Vulnerability' AS fact_type, CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'R' THEN 'Major' ELSE 'Minor' END AS severity, 'ruff-E' || "
    f"(l_partkey % 500) AS owasp_category, '[E' || (l_partkey % 500) || '] text ' || l_orderkey AS message, {_FILE.format(text='varchar')} AS file, "
    "l_linenumber AS start_line, CASE WHEN l_linenumber > 3 THEN l_linenumber + 1 ELSE l_linenumber END AS end_line, (l_suppkey % 80 + 1)::INT AS "
    "start_column FROM lineitem",
)


def _coverage_lines(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.concat(F.lit("com.app"), (F.col("l_suppkey") % 9).cast("string")).alias("package"), F.concat(F.lit("com/app/C"), (F.col("l_partkey") % 30).cast("string")).alias("class"), (F.col("l_orderkey") % 400 + 1).cast("int").alias("nr"), (F.col("l_linenumber") % 3).cast("int").alias("mi"), F.col("l_quantity").cast("int").alias("q")).select("package", "class", "nr", "mi", (F.col("q") % 4).alias("ci"))


query(
    "src_18_uncovered_lines",
    lambda v: reports.uncovered(_coverage_lines(v)),
    "SELECT 'UncoveredLine' AS fact_type, 'com/app' || (l_suppkey % 9) || '/C' || (l_partkey % 30) || '.java' AS file, (l_orderkey % 400 + 1)::INT AS "
    "start_line, (l_orderkey % 400 + 1)::INT AS end_line FROM lineitem WHERE l_linenumber % 3 > 0 OR l_quantity::INT % 4 = 0",
)
query(
    "src_19_line_coverage",
    lambda v: reports.line_coverage(_coverage_lines(v)),
    "SELECT package, class, nr, round(CASE WHEN mi + ci > 0 THEN ci * 100.0 / (mi + ci) ELSE 0 END::DOUBLE, 4) AS percent FROM (SELECT 'com.app' || "
    "(l_suppkey % 9) AS package, 'com/app/C' || (l_partkey % 30) AS class, (l_orderkey % 400 + 1)::INT AS nr, l_linenumber % 3 AS mi, l_quantity::INT % 4 "
    "AS ci FROM lineitem)",
)
query(
    "src_22_formatted",
    lambda v: texts.formatted(v.facts.select("fact_id", "file", "severity"), "text"),
    "SELECT 'fact_id=' || fact_id || ' file=' || file || ' severity=' || coalesce(severity, '-') AS line FROM facts",
    "facts",
)

# Source texts.
_LINES = "SELECT doc_id, lang, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
query(
    "src_27_lines",
    lambda v: texts.lines(v.table("documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars")),
    f"SELECT doc_id, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM ({_LINES}) GROUP BY 1",
)
query(
    "src_29_marked_lines",
    lambda v: texts.marked_lines(texts.lines(v.table("documents")), "License").select("doc_id", F.col("line").cast("long").alias("line"), "severity"),
    f"SELECT doc_id, line, 'Minor' AS severity FROM ({_LINES}) WHERE contains(text, 'License')",
)
_PATTERNS = [("no-token", "en", "token", "security", "error"), ("no-la", "fr", " la ", "layout", "warning"), ("no-und", "de", " und ", "error-handling", "info"), ("no-password", "es", "password", "vulnerability", "hint")]
_PATTERN_SQL = "(VALUES " + ", ".join(str(p) for p in _PATTERNS) + ") p(rule, language, pattern, category, level)"


def _matches(v: Views) -> DataFrame:
    rules = v.spark.createDataFrame(_PATTERNS, "rule string, language string, pattern string, category string, level string")
    return texts.pattern_facts(texts.lines(v.table("documents"), keep=("lang",)), F.broadcast(rules)).withColumn("line", F.col("line").cast("long"))  # a fixed list of rules


_MATCHED = f"SELECT doc_id, line, rule, CASE WHEN category IN ('security', 'vulnerability') THEN 'Vulnerability' ELSE 'CodeSmell' END AS fact_type, {sev.sql_case('level', sev.FROM_PATTERN_RULE, chr(39) + 'Minor' + chr(39))} AS severity, CASE WHEN category IN ('security', 'vulnerability') THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM ({_LINES}) JOIN {_PATTERN_SQL} ON lang = language AND contains(text, pattern)"
query("src_25_pattern_facts", _matches, _MATCHED)
query(
    "src_26_match_severity",
    lambda v: _matches(v).groupBy("rule", "fact_type", "severity").agg(F.count("*").alias("n")),
    f"SELECT rule, fact_type, severity, count(*) AS n FROM ({_MATCHED}) GROUP BY ALL",
)
query(
    "src_28_smells_of_rules",
    lambda v: _matches(v).where("fact_type = 'CodeSmell'").select("doc_id", "line", "rule", "confidence"),
    f"SELECT doc_id, line, rule, confidence FROM ({_MATCHED}) WHERE fact_type = 'CodeSmell'",
)
query("flt_18_not_matched", lambda v: texts.unmatched(texts.lines(v.table("documents")), "the"), "SELECT doc_id FROM documents WHERE NOT contains(coalesce(text, ''), 'the')")
query(
    "flt_19_rules_for_language",
    lambda v: v.table("documents").join(F.broadcast(_pattern_rules(v)), F.col("lang") == F.col("language")).groupBy("rule").agg(F.count("*").alias("n")),
    f"SELECT rule, count(*) AS n FROM documents JOIN {_PATTERN_SQL} ON lang = language GROUP BY 1",
)
query(
    "src_43_line_counts",
    lambda v: texts.counts(texts.lines(v.table("documents")), {"tokens": "token *=", "licensed": "^Licensed"}),
    "SELECT count(*) AS lines, count(*) FILTER (regexp_matches(text, 'token *=')) AS tokens, count(*) FILTER (regexp_matches(text, '^Licensed')) AS "
    f"licensed FROM ({_LINES})",
)
query(
    "agg_33_rule_tests",
    lambda v: _rule_tests(v),
    "SELECT rule, count(*) AS total, count(*) FILTER (hit = expected) AS passed FROM (SELECT p.rule, d.doc_id, contains(coalesce(d.text, ''), p.pattern) "
    f"AS hit, d.doc_id % 2 = 0 AS expected FROM documents d JOIN {_PATTERN_SQL} ON d.lang = p.language) GROUP BY 1",
)


def _pattern_rules(v: Views) -> DataFrame:
    return v.spark.createDataFrame(_PATTERNS, "rule string, language string, pattern string, category string, level string")


def _rule_tests(v: Views) -> DataFrame:
    rules = F.broadcast(v.spark.createDataFrame(_PATTERNS, "rule string, language string, pattern string, category string, level string"))
    cases = v.table("documents").join(rules, F.col("lang") == F.col("language")).select("rule", F.coalesce(F.col("text"), F.lit("")).contains(F.col("pattern")).alias("hit"), (F.col("doc_id") % 2 == 0).alias("expected"))
    return cases.groupBy("rule").agg(F.count("*").alias("total"), F.count_if(F.col("hit") == F.col("expected")).alias("passed"))


# Rules as rows.
RULES = [
    rulebook.Rule("uncovered weakness", "Vulnerability", "severity IN ('Critical', 'Major') AND confidence > 0.93 AND start_line >= 2", (("UncoveredLine", "true"),), ("file", "start_line"), "High"),
    rulebook.Rule("long_smell", "CodeSmell", "lines_of_code >= 40 AND regexp_like(message, '1$') AND contains(file, '2')", severity="Low", confidence=0.5),
]
_R1 = """SELECT 'uncovered weakness' AS rule_name, fact_type || ' at ' || file || ':' || start_line AS message, file, start_line, confidence, 'Major' AS severity FROM facts f
WHERE fact_type = 'Vulnerability' AND severity IN ('Critical', 'Major') AND confidence > 0.93 AND start_line >= 2
  AND EXISTS (SELECT 1 FROM facts u WHERE u.fact_type = 'UncoveredLine' AND f.file = u.file AND f.start_line = u.start_line)"""
_R2 = """SELECT 'long_smell', fact_type || ' at ' || file || ':' || start_line, file, start_line, 0.5::DOUBLE, 'Info' FROM facts
WHERE fact_type = 'CodeSmell' AND lines_of_code >= 40 AND regexp_matches(message, '1$') AND contains(file, '2')"""
query(
    "dsl_evaluated_rules",
    lambda v: rulebook.evaluate(RULES, v.store).select("rule_name", "message", "file", "start_line", "confidence", "severity"),
    f"{_R1} UNION ALL {_R2}",
    "facts",
)
_HUNDRED = [rulebook.Rule(f"rule {k}", ("Vulnerability", "CodeSmell")[k % 2], f"lines_of_code % 50 = {k // 2} AND confidence > 0.92") for k in range(100)]
query(
    "rule_hundred_in_one_scan", lambda v: rulebook.results(_HUNDRED, v.facts, 300).select("rule_name", "n_findings", "failed"),
    """SELECT 'rule ' || k AS rule_name, CASE WHEN count(fact_id) > 300 THEN 0 ELSE count(fact_id) END AS n_findings, count(fact_id) > 300 AS failed FROM range(100) r(k)
LEFT JOIN facts ON fact_type = CASE k % 2 WHEN 0 THEN 'Vulnerability' ELSE 'CodeSmell' END AND lines_of_code % 50 = k // 2 AND confidence > 0.92 GROUP BY k""", "facts",
)

# A table of rules, one for each part.
_RULE_ROWS = """SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN '../' || p_name WHEN 2 THEN repeat(p_name || '-', 9) WHEN 3 THEN 'twice' ELSE p_name || ' ' || p_partkey END AS name,
  CASE p_size % 7 WHEN 0 THEN 'Nothing' ELSE 'Vulnerability' END AS kind,
  CASE p_size % 4 WHEN 0 THEN 'foo(name) > 1' WHEN 1 THEN 'contains(message, ''{{x}}'')' WHEN 2 THEN 'true' ELSE 'confidence > 0.5' END AS condition,
  p_size % 3 = 0 AS paired, p_size % 6 = 0 AS related, CASE p_size % 5 WHEN 0 THEN 'Odd' WHEN 1 THEN 'High' ELSE 'Low' END AS severity FROM part"""


def _rule_rows(v: Views) -> DataFrame:
    rows = v.spark.sql(_RULE_ROWS.replace("FROM part", "FROM {part}").replace("''{{x}}''", "\\'{{{{x}}}}\\'"), part=v.table("part"))
    other = F.array(F.struct(F.lit("UncoveredLine").alias("kind"), F.lit("true").alias("condition")))
    none = F.array().cast("array<struct<kind: string, condition: string>>")
    return rows.withColumn("others", F.when(F.col("paired"), other).otherwise(none)).withColumn("shared", F.when(F.col("related"), F.array(F.lit("file"))).otherwise(F.array().cast("array<string>")))


_PROBLEMS = f"""SELECT p_partkey, concat_ws('; ', CASE WHEN name = '' THEN 'the name is empty' END, CASE WHEN length(name) > 100 THEN 'the name is too long' END,
  CASE WHEN contains(name, '..') OR contains(name, '/') THEN 'the name has a path in it' END, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'the name is used twice' END,
  CASE WHEN severity = 'Odd' THEN 'unknown severity Odd' END, CASE WHEN kind = 'Nothing' THEN 'unknown fact type Nothing' END, CASE WHEN paired AND NOT related THEN 'several patterns share no variable' END,
  CASE WHEN contains(condition, 'foo(') THEN 'unknown function foo' END, CASE WHEN contains(condition, '{{{{') THEN 'a text has a template in it' END) AS problems FROM ({_RULE_ROWS})"""
query("flt_12_rule_checks", lambda v: rulebook.checked(_rule_rows(v)).select("p_partkey", F.array_join("problems", "; ").alias("problems")), _PROBLEMS)
query(
    "flt_13_valid_rules",
    lambda v: rulebook.checked(_rule_rows(v)).where(F.size("problems") == 0).select("p_partkey", "severity"),
    f"SELECT p_partkey, severity FROM ({_RULE_ROWS}) JOIN ({_PROBLEMS}) USING (p_partkey) WHERE problems = ''",
)
_SCORED = f"SELECT p_partkey, least(100.0, 10.0 * (4 * (1 + paired::INT) - (condition <> 'true')::INT))::DOUBLE AS score FROM ({_RULE_ROWS})"
query(
    "flt_14_complexity", lambda v: _rule_rows(v).select("p_partkey", rulebook.complexity(F.size("others") + 1, F.col("condition") != "true").alias("score")).withColumn("level", sev.complexity_level(F.col("score"))),
    f"SELECT p_partkey, score, CASE WHEN score < 20 THEN 'Low' WHEN score < 50 THEN 'Medium' WHEN score < 80 THEN 'High' ELSE 'Critical' END AS level FROM ({_SCORED})",
)

# The catalogue of web risks over all facts.
_CATALOGUE = "(VALUES " + ", ".join(str((*r[:4], list(r[4]))) for r in rulebook.CATALOGUE) + ") c(id, name, category, severity, cwe)"
query(
    "src_42_catalogue",
    lambda v: rulebook.catalogued(v.facts, rulebook.catalogue(v.spark)).groupBy("rule_id", "category").agg(F.count("*").alias("n")),
    f"SELECT id AS rule_id, category, count(*) AS n FROM facts JOIN {_CATALOGUE} ON list_contains(cwe, substr(cwe_id, 5)::INT) GROUP BY ALL",
    "facts",
)
query(
    "src_42_of_category",
    lambda v: rulebook.catalogue(v.spark, category="A03-Injection").select("id", "name", "severity"),
    f"SELECT id, name, severity FROM {_CATALOGUE} WHERE category = 'A03-Injection'",
)
query("src_42_of_severity", lambda v: rulebook.catalogue(v.spark, severity="critical").select("id"), f"SELECT id FROM {_CATALOGUE} WHERE severity = 'critical'")
query(
    "agg_34_catalogue_by_severity",
    lambda v: rulebook.catalogue(v.spark).groupBy("severity").agg(F.count("*").alias("rules"), F.count_distinct("category").alias("categories")),
    f"SELECT severity, count(*) AS rules, count(DISTINCT category) AS categories FROM {_CATALOGUE} GROUP BY 1",
)

query(
    "agg_20_exported",
    lambda v: quality.prometheus(quality.aggregate(v.facts, "count").select(F.lit("facts").alias("metric"), "value")),
    "SELECT 'quality_facts ' || printf('%.2f', count(*)::DOUBLE) AS line FROM facts",
    "facts",
)

# Files of facts: written, and read back.
_BRIEF = "fact_id string, fact_type string, file string, start_line int"


def _fact_files(v: Views) -> DataFrame:
    path = v.stored("fact-files", lambda path: v.facts.select("fact_id", "fact_type", "file", "start_line").write.json(path))
    return texts.read_facts(v.spark, path, _BRIEF)


query("src_20_fact_files", _fact_files, "SELECT fact_id, fact_type, file, start_line FROM facts", "facts")

# A stream of requests, published in batches.
_VALID = "l_quantity > 5 AND l_discount < 0.09"


def _published(v: Views) -> DataFrame:
    def run(path: str) -> None:
        rows = read_events(v.spark, v.sf_dir, schema=v.table("lineitem").schema, name="lineitem.parquet")
        publish(rows, path, f"{path}-progress", F.expr(_VALID)).awaitTermination()

    path = v.stored("published", run)
    read = lambda kind: v.spark.read.parquet(f"{path}/{kind}").select("l_orderkey", "l_returnflag", F.lit(kind).alias("outcome"))
    return read("accepted").union(read("rejected")).groupBy("l_returnflag", "outcome").agg(F.count("*").alias("n"))


query("str_01_published", _published, f"SELECT l_returnflag, CASE WHEN {_VALID} THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS n FROM lineitem GROUP BY ALL")

# Batch twins of streams.
query(
    "str_02_daily_events",
    lambda v: v.table("events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n")),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
)
query(
    "str_06_requests_per_minute",
    lambda v: requests_per_minute(v.table("events").withColumn("user_id", F.col("user_id") % 3), "user_id", 1),
    "SELECT user_id % 3 AS user_id, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM events GROUP BY "
    "ALL",
)


def _limited(v: Views) -> DataFrame:
    """Two requests a user, one more for each whole day: the stream over all events, and what it wrote."""

    def run(path: str) -> None:
        events = read_events(v.spark, v.sf_dir, name="events.parquet")
        stream = rate_limited(events, "user_id", 2, 1, 86_400).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at")
        stream.trigger(availableNow=True).start().awaitTermination()

    return v.spark.read.parquet(f"{v.stored('limited', run)}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _by_project(v: Views) -> DataFrame:
    """All events, sent by type as a stream, which is started again when it is done: each event is there once."""
    events = read_events(v.spark, v.sf_dir, name="events.parquet")

    def run(path: str) -> None:
        for _ in range(2):
            fanned_out(events, f"{path}/out", f"{path}/at", "event_type").awaitTermination()

    return received(v.spark, f"{v.stored('sent', run)}/out", events.schema, "event_type")


query("str_03_fanned_out", lambda v: _by_project(v).select("event_id", "event_type", "user_id", "value", "ts"), "SELECT event_id, event_type, user_id, value, ts FROM events")
query(
    "str_06_rate_limit",
    _limited,
    """WITH RECURSIVE e AS (SELECT user_id, ts, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT user_id, ts, k, 1::BIGINT AS tokens, s AS filled, true AS allowed FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, ts, k, have - CASE WHEN have > 0 THEN 1 ELSE 0 END, filled, have > 0 FROM (
    SELECT e.user_id, e.ts, e.k, CASE WHEN s - filled >= 86400 THEN least(2, tokens + (s - filled) // 86400) ELSE tokens END AS have, CASE WHEN s - filled >= 86400 THEN s ELSE filled END AS filled
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, ts, allowed FROM r""",
)
query(
    "str_03_project_events",
    lambda v: v.table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts")),
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1",
)


# Models, expectations, stores.


def _nodes(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "cfg").otherwise("dfg").alias("graph"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_orderkey") % 300).alias("node"))


def _model(v: Views) -> DataFrame:
    method = F.struct(F.concat(F.lit("do"), F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 4).cast("int").alias("parameters"))
    return v.table("part").groupBy(F.col("p_brand").alias("package"), F.col("p_type").alias("class")).agg(F.collect_list(method).alias("methods"))


def _actual(v: Views) -> DataFrame:
    return v.facts.where("severity = 'Critical'").select("fact_type", "severity", "message")


def _expected(v: Views) -> DataFrame:
    return v.facts.where("severity = 'Critical' and start_line < 4 or severity = 'Blocker'").select("fact_type", "severity", "message")


_ACTUAL, _EXPECTED = "SELECT fact_type, severity, message FROM facts WHERE severity = 'Critical'", "SELECT fact_type, severity, message FROM facts WHERE severity = 'Critical' AND start_line < 4 OR severity = 'Blocker'"
query(
    "graph_06_node_facts",
    lambda v: model.node_facts(_nodes(v)),
    "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Function' ELSE 'Variable' END AS fact_type, 'n' || l_partkey AS name, (l_orderkey % 300 + 1)::INT AS "
    "start_line, 0.9::DOUBLE AS confidence FROM lineitem",
)
_DECLARED = "SELECT CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'R' THEN 'sink' WHEN 'N' THEN 'sanitizer' END AS role, 'v' || (l_partkey % 50) AS name, CASE l_suppkey % 3 WHEN 0 THEN 'sql' ELSE 'xss' END AS category, CASE WHEN l_linenumber > 1 THEN 'flow-' || l_orderkey END AS flow FROM lineitem"
query(
    "graph_07_taint_facts", lambda v: model.taint_facts(v.spark.sql(_DECLARED.replace("FROM lineitem", "FROM {rows}"), rows=v.table("lineitem"))).groupBy("fact_type", "name", "category", "severity", "effective", "confidence").agg(F.count("*").alias("n"), F.count_distinct("flow_id").alias("flows")),
    f"""SELECT CASE role WHEN 'source' THEN 'TaintSource' WHEN 'sink' THEN 'TaintSink' ELSE 'Sanitization' END AS fact_type, name, CASE WHEN role <> 'sanitizer' THEN category END AS category, CASE WHEN role = 'sink' THEN 'Major' END AS severity,
  CASE WHEN role = 'sanitizer' THEN TRUE END AS effective, CASE WHEN role = 'sanitizer' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, count(*) AS n, count(DISTINCT coalesce(flow, 'own ' || category)) AS flows
FROM ({_DECLARED}) WHERE role = 'source' OR flow IS NOT NULL GROUP BY ALL""",
)
query(
    "src_33_methods_of_package",
    lambda v: model.methods_of(_model(v), "Brand#2"),
    "SELECT p_type AS class, 'do' || p_size AS method, (p_partkey % 4)::INT AS parameters FROM part WHERE p_brand = 'Brand#2'",
)
query(
    "join_23_expectations",
    lambda v: model.expectations(_actual(v), _expected(v), ["fact_type", "severity", "message"]),
    "SELECT fact_type, severity, message, CASE WHEN bool_or(a) AND bool_or(e) THEN 'matched' WHEN bool_or(a) THEN 'unexpected' ELSE 'missing' END AS "
    f"outcome FROM (SELECT *, TRUE AS a, FALSE AS e FROM ({_ACTUAL}) UNION ALL SELECT *, FALSE, TRUE FROM ({_EXPECTED})) GROUP BY ALL",
    "facts",
)
query(
    "rem_28_snapshot",
    lambda v: model.snapshot_difference(_actual(v), _expected(v)),
    f"SELECT *, 'new' AS side FROM ({_ACTUAL} EXCEPT ALL {_EXPECTED}) UNION ALL SELECT *, 'gone' FROM ({_EXPECTED} EXCEPT ALL {_ACTUAL})",
    "facts",
)
query(
    "rem_06_node_counts",
    lambda v: _nodes(v).groupBy("graph").agg(F.count("*").alias("nodes")),
    "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'cfg' ELSE 'dfg' END AS graph, count(*) AS nodes FROM lineitem GROUP BY 1",
)
query("rem_07_policy_patterns", lambda v: v.flows.select("category").distinct(), "SELECT DISTINCT category FROM flows", "flows")
_UNITS = "CASE o_orderkey % 5 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' ELSE 'd' END"
query(
    "fn_13_durations",
    lambda v: v.table("orders").select("o_orderkey", duration_ms(F.expr(f"(o_orderkey % 900) || {_UNITS}")).alias("ms")),
    "SELECT o_orderkey, o_orderkey % 900 * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 END AS ms FROM orders",
)
_FOREIGN = """to_json(named_struct('id', 'r' || p_partkey, 'pattern', CASE WHEN p_size % 2 = 0 THEN p_name END, 'patterns', CASE WHEN p_size % 2 = 1 THEN array(named_struct('pattern', p_type), named_struct('pattern', p_brand)) END,
  'severity', CASE p_size % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' END, 'languages', array(p_brand, 'any')))"""
_TRANSLATED = "SELECT 'r' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS pattern, p_brand AS language, CASE p_size % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM part"
query(
    "src_38_translated_rules",
    lambda v: texts.translated(v.table("part").select(F.expr(_FOREIGN).alias("rule")), "rule").select("id", "pattern", "language", "severity"),
    _TRANSLATED,
)
query(
    "src_40_config",
    lambda v: v.spark.createDataFrame([(n, c.get("timeout_ms")) for n, c in texts.load_config('[[extractors]]\nname = "a"\ntimeout = "30s"\n', '[[extractors]]\nname = "b"\ntimeout = "5m"\n').items()], "name string, timeout_ms long"),
    "SELECT * FROM (VALUES ('a', 30000::BIGINT), ('b', 300000)) c(name, timeout_ms)",
)
query(
    "src_39_loaded_rules",
    lambda v: v.spark.createDataFrame([(r["id"], r["language"]) for r in texts.load_rules('{"rules": [{"id": "x", "language": "python", "pattern": "eval("}]}')], "id string, language string"),
    "SELECT 'x' AS id, 'python' AS language",
)
query(
    "agg_34_rule_statistics",
    lambda v: texts.translated(v.table("part").select(F.expr(_FOREIGN).alias("rule")), "rule").groupBy("severity").agg(F.count("*").alias("n")),
    f"SELECT severity, count(*) AS n FROM ({_TRANSLATED}) GROUP BY 1",
)
