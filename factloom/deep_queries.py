"""Registered queries of the operators that take several rounds: bindings of many patterns, recursive rules, searches between sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import versioned
from factloom.operators.patterns import Pattern, bindings
from factloom.operators.recursion import Atom, Rule, Value, solve
from factloom.operators.search import shortest_paths
from factloom.plans import rulebook
from factloom.queries import PROJECT, Views, query
from factloom.sources.transaction import Transaction
from factloom.streaming import fanned_out, received
from factloom.whole_queries import UPSERTED_SQL, status_changes

# Three and four patterns: a weakness, a bare line in its file, a smell in its flow, and an informal smell in that one's file.
_WEAK = Pattern("weak", "Vulnerability", {"f": "file", "w": "flow_id"}, "severity = 'Critical'")
_BARE = Pattern("bare", "UncoveredLine", {"f": "file"})
_SMELL = Pattern("smell", "CodeSmell", {"w": "flow_id", "g": "file"}, "severity = 'Blocker'")
_NOTE = Pattern("note", "CodeSmell", {"g": "file", "e": "extractor"}, "severity = 'Minor'")
_FOUND = Pattern("found", "Vulnerability", {"e": "extractor", "f": "file"}, exists=True)
_THREE = "FROM facts a JOIN facts b ON a.file = b.file JOIN facts c ON a.flow_id = c.flow_id {more} WHERE a.fact_type = 'Vulnerability' AND a.severity = 'Critical' AND b.fact_type = 'UncoveredLine' AND c.fact_type = 'CodeSmell' AND c.severity = 'Blocker'"
_IDS = "a.fact_id AS weak, b.fact_id AS bare, c.fact_id AS smell"


def _ids(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"{n}_fact_id").alias(n) for n in names])


query("join_02_three_patterns", lambda v: _ids(bindings(v.store, [_BARE, _SMELL, _WEAK]), "weak", "bare", "smell"), f"SELECT {_IDS} {_THREE.format(more='')}", "facts")
query(
    "join_02_four_patterns",
    lambda v: _ids(bindings(v.store, [_NOTE, _BARE, _SMELL, _WEAK]), "weak", "bare", "smell", "note"),
    f"SELECT {_IDS}, d.fact_id AS note {_THREE.format(more='JOIN facts d ON c.file = d.file')} AND d.fact_type = 'CodeSmell' AND d.severity = 'Minor'",
    "facts",
)
query(
    "join_06_bound_and_existing",
    lambda v: _ids(bindings(v.store, [_WEAK, Pattern("bare", "UncoveredLine", {"f": "file", "e": "extractor"}), _FOUND]), "weak", "bare"),
    "SELECT a.fact_id AS weak, b.fact_id AS bare FROM facts a JOIN facts b ON a.file = b.file WHERE a.fact_type = 'Vulnerability' AND a.severity = 'Critical' AND b.fact_type = 'UncoveredLine' AND "
    "EXISTS (SELECT 1 FROM facts x WHERE x.fact_type = 'Vulnerability' AND x.file = b.file AND x.extractor = b.extractor)",
    "facts",
)

# Taint that passes on: from a sink of one flow to a source of another on the next line of the same file.
_RULES = [
    Rule(Atom("tainted", "f"), [Atom("source", "f", Value(True))]),
    Rule(Atom("tainted", "g"), [Atom("tainted", "f"), Atom("passes", "f", "g")]),
    Rule(Atom("flows_to_sink", "f", "func"), [Atom("sink", "f", "func"), Atom("tainted", "f")]),
    Rule(Atom("sanitized", "f"), [Atom("sanitizer", "f", Value(True)), Atom("tainted", "f")]),
    Rule(Atom("unsanitized", "f", "func"), [Atom("flows_to_sink", "f", "func")], absent=[Atom("sanitized", "f")]),
]


def _on_next_line(steps: DataFrame, column: str) -> DataFrame:
    """src, dst: the column of a sink and of a source on the next line of its file."""
    sinks = steps.where("fact_type = 'TaintSink'").select("file_id", (F.col("line") + 1).alias("line"), F.col(column).alias("src"))
    return sinks.join(steps.where("fact_type = 'TaintSource'").select("file_id", "line", F.col(column).alias("dst")), ["file_id", "line"]).select("src", "dst")


def _taint(v: Views, name: str, *columns: str) -> DataFrame:
    steps = v.flow_steps
    tables = {
        "source": steps.where("fact_type = 'TaintSource' AND var = 'request_param'").select("flow_id", "untrusted"),
        "sink": steps.where("fact_type = 'TaintSink'").select("flow_id", "func"),
        "sanitizer": steps.where("fact_type = 'Sanitization'").select("flow_id", "effective"),
        "passes": _on_next_line(steps, "flow_id"),
    }
    needed = {"tainted": 2, "flows_to_sink": 3, "sanitized": 4, "unsanitized": 5}
    return solve({k: t.distinct() for k, t in tables.items()}, _RULES[: needed[name]])[name].toDF(*columns)


_TAINTED = """WITH RECURSIVE p AS (SELECT DISTINCT a.flow_id AS f, b.flow_id AS g FROM flow_steps a JOIN flow_steps b ON a.file_id = b.file_id AND a.line + 1 = b.line
  WHERE a.fact_type = 'TaintSink' AND b.fact_type = 'TaintSource'),
t AS (SELECT flow_id AS f FROM flow_steps WHERE fact_type = 'TaintSource' AND var = 'request_param' AND untrusted UNION SELECT g FROM t JOIN p USING (f)),
s AS (SELECT DISTINCT flow_id, func FROM flow_steps WHERE fact_type = 'TaintSink' AND flow_id IN (FROM t)),
c AS (SELECT DISTINCT flow_id FROM flow_steps WHERE fact_type = 'Sanitization' AND effective AND flow_id IN (FROM t)) """
query("graph_05_spreading_taint", lambda v: _taint(v, "tainted", "flow_id"), _TAINTED + "SELECT f AS flow_id FROM t", "flow_steps")
query("join_08_spread_to_sinks", lambda v: _taint(v, "flows_to_sink", "flow_id", "func"), _TAINTED + "SELECT * FROM s", "flow_steps")
query("join_09_spread_sanitized", lambda v: _taint(v, "sanitized", "flow_id"), _TAINTED + "SELECT * FROM c", "flow_steps")
query("join_10_spread_unsanitized", lambda v: _taint(v, "unsanitized", "flow_id", "func"), _TAINTED + "SELECT * FROM s WHERE flow_id NOT IN (FROM c)", "flow_steps")


def _taint_paths(v: Views) -> DataFrame:
    """Shortest ways of taint, from flow to flow, from those with untrusted parameters to sinks that render pages. Flows are the nodes, so that a
    flow of m sources and n sinks has n edges, not m * n."""
    steps = v.flow_steps
    out = steps.where("fact_type = 'TaintSink' AND func = 'render_page'").select(F.col("flow_id").alias("src"), F.col("node").alias("dst"))
    sources = steps.where("fact_type = 'TaintSource' AND var = 'request_param' AND untrusted").select(F.col("flow_id").alias("node"))
    return shortest_paths(_on_next_line(steps, "flow_id").union(out), sources, out.select(F.col("dst").alias("node")))


query(
    "join_12_taint_paths",
    lambda v: _taint_paths(v).select("sink", F.col("steps").cast("long").alias("steps"), F.size("path").cast("long").alias("nodes")),
    """WITH RECURSIVE e AS (SELECT DISTINCT flow_id AS src, node AS dst FROM flow_steps WHERE fact_type = 'TaintSink' AND func = 'render_page'
  UNION SELECT a.flow_id, b.flow_id FROM flow_steps a JOIN flow_steps b ON a.file_id = b.file_id AND a.line + 1 = b.line WHERE a.fact_type = 'TaintSink' AND b.fact_type = 'TaintSource'),
r(node, depth) AS (SELECT flow_id, 0::BIGINT FROM flow_steps WHERE fact_type = 'TaintSource' AND var = 'request_param' AND untrusted UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 60)
SELECT node AS sink, min(depth) AS steps, min(depth) + 1 AS nodes FROM r WHERE node IN (SELECT node FROM flow_steps WHERE fact_type = 'TaintSink' AND func = 'render_page') GROUP BY node""",
    "flow_steps",
)


_STORED = "analysis_id long, line int, col int, file string, fingerprint string, severity string, seq long"


def _database(v: Views) -> dict[str, str]:
    """All findings, stored in a database in one transaction. The database is a file in the shared folder, which must be a path that all machines mount;
    with a server it would be that one's address."""

    def run(path: str) -> None:
        plain = path.removeprefix("file://")
        if "://" in plain:
            raise ValueError("a database file needs a shared folder that is mounted")
        found = v.stored_findings.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _STORED.split(", ")])
        found.write.format("transaction").options(module="sqlite3", url=plain, table="findings", run="findings").mode("append").save()

    v.spark.dataSource.register(Transaction)
    return {"module": "sqlite3", "url": v.stored("findings-db", run).removeprefix("file://"), "table": "findings", "by": "seq"}


def _streamed(v: Views) -> DataFrame:
    """The database's findings, read as a stream by ranges of their number and fanned out by severity."""
    options = _database(v)

    def run(path: str) -> None:
        found = v.spark.readStream.format("transaction").schema(_STORED).options(**options).load()
        fanned_out(found, f"{path}/out", f"{path}/at", "severity").awaitTermination()

    return received(v.spark, f"{v.stored('streamed', run)}/out", v.spark.createDataFrame([], _STORED).schema, "severity")


_ALL = "SELECT analysis_id, line, col, file, fingerprint, severity, seq FROM stored_findings"
query("src_34_transaction", lambda v: v.spark.read.format("transaction").schema(_STORED).options(**_database(v)).load(), _ALL, "stored_findings")
query("src_41_streamed", _streamed, _ALL, "stored_findings")

# A thousand rules of their own names, messages and conditions, evaluated together.
_THOUSAND = [
    rulebook.Rule(f"rule {k}", ("Vulnerability", "CodeSmell")[k % 2], f"lines_of_code % 50 = {k // 2 % 50} AND start_line % 10 = {k // 100} AND confidence > 0.9", severity=("High", "Low")[k % 2], message=f"{k}: {{fact.type}} in {{location.file}}")
    for k in range(rulebook.MOST_RULES)
]
query(
    "rule_thousand_in_one_scan",
    lambda v: rulebook.evaluate(_THOUSAND, v.store).select("rule_name", "message", "file", "start_line", "severity"),
    f"SELECT 'rule ' || k AS rule_name, k || ': ' || fact_type || ' in ' || file AS message, file, start_line, CASE k % 2 WHEN 0 THEN 'Major' ELSE 'Info' END AS severity FROM facts, range({rulebook.MOST_RULES}) r(k) "
    "WHERE fact_type = CASE k % 2 WHEN 0 THEN 'Vulnerability' ELSE 'CodeSmell' END AND lines_of_code % 50 = k // 2 % 50 AND start_line % 10 = k // 100 AND confidence > 0.9",
    "facts",
)


# The baseline as a table in buckets: changes are deltas, merged when they are read.
_KEYS = ["project", "fingerprint"]


def _baseline(v: Views, name: str) -> str:
    return v.stored(name, lambda path: versioned.create(v.baseline_status, path, _KEYS))


def _upserted(v: Views) -> DataFrame:
    path = _baseline(v, "baseline-upserted")
    versioned.change(v.spark, path, status_changes(v), ["seq", "analysis_id"])
    return versioned.current(v.spark, path)


def _removed(v: Views) -> DataFrame:
    path = _baseline(v, "baseline-removed")
    versioned.change(v.spark, path, deleted=v.stored_findings.where("severity = 'Info'").select(F.lit(PROJECT).alias("project"), "fingerprint"))
    return versioned.current(v.spark, path)


query("mut_01_in_buckets", _upserted, UPSERTED_SQL, "baseline_status", "stored_findings")
query(
    "mut_05_in_buckets",
    _removed,
    f"SELECT * FROM baseline_status WHERE NOT (project = '{PROJECT}' AND fingerprint IN (SELECT fingerprint FROM stored_findings WHERE severity = 'Info'))",
    "baseline_status",
    "stored_findings",
)
