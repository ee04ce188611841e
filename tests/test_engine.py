import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.dynamic import Registry, value_type
from factloom.operators import governance as gov
from factloom.operators import graph, quality, rules, store
from factloom.plans import rulebook
from factloom.plans.rulebook import Rule
from factloom.streaming import daily_counts, publish, rate_limited, read_events

FACTS = "fact_id string, fact_type string, file string, start_line int, end_line int, severity string, confidence double, message string"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


def few(spark):
    return facts(
        spark,
        ("v1", "Vulnerability", "a.rs", 10, 70, "Critical", 0.9, "one"), ("v2", "Vulnerability", "a.rs", 200, 200, "Blocker", 0.6, "two"),
        ("u1", "UncoveredLine", "a.rs", 10, 10, None, 1.0, "x"), ("u2", "UncoveredLine", "a.rs", 65, 66, None, 1.0, "x"), ("s1", "CodeSmell", "b.rs", 1, 1, "Minor", 0.8, "y"),
    )


@pytest.mark.parametrize(("pattern", "text", "wanted"), [("test*", "testing", True), ("*test", "mytest", True), ("te*st", "tebest", True), ("*test*", "atestb", True), ("te*st", "tes", False), ("test?", "test1", False), ("t?st*", "tast1", True), ("a.c", "abc", False)])
def test_glob(spark, pattern, text, wanted):
    assert spark.range(1).select(tx.glob(F.lit(text), pattern).alias("x")).first().x is wanted


def test_store_and_joins(spark):
    df = few(spark)
    assert {r.fact_id for r in store.by_location(df, "a.rs", 66, 90).collect()} == {"v1", "u2"}
    assert [tuple(r) for r in rules.overlap_join(df, "Vulnerability", "UncoveredLine").orderBy("right_fact_id").collect()] == [("a.rs", "v1", "u1"), ("a.rs", "v1", "u2")]
    assert [r.left_fact_id for r in rules.location_join(df, "Vulnerability", "UncoveredLine").collect()] == ["v1"]
    assert rules.exists_all(df, "Vulnerability", "UncoveredLine").count() == 1


def test_written_by_type(spark, tmp_path, capsys):
    store.written_by_type(few(spark), str(tmp_path / "facts"))
    df = store.by_type(spark.read.parquet(str(tmp_path / "facts")), "CodeSmell")
    df.explain("formatted")
    assert "PartitionFilters: [isnotnull" in capsys.readouterr().out and df.count() == 1


def test_score_ignores_blockers(spark):
    assert quality.score(few(spark)).first().score == 89.0
    assert quality.percentile(spark.range(10).select(F.col("id").alias("x")), "x", 50).first().value == 5.0
    assert quality.percentile(spark.range(0).select(F.col("id").alias("x")), "x", 50).first().value == 0.0


def test_summary_does_not_follow_the_order_of_rows(spark):
    """Means of 0.1 and 0.2 parts that end in a half of the sixth place; NaN and null are left out."""
    rows = few(spark).limit(1).drop("confidence").withColumn("lines_of_code", F.lit(1)).crossJoin(spark.range(2000))
    tie = rows.withColumn("confidence", F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.100001))
    for part in (tie.coalesce(1), tie.repartition(7), tie.orderBy(F.desc("confidence"))):
        assert quality.summary(part).first().mean_confidence == 0.100001
    odd = rows.limit(3).withColumn("confidence", F.when(F.col("id") == 0, float("nan")).when(F.col("id") == 1, 0.5))
    assert quality.summary(odd).first().mean_confidence == 0.5


def test_gates(spark):
    measured = quality.metrics(few(spark))
    held = {r.gate: r.violated for r in quality.evaluate(measured, quality.gates(spark, [("eq", "FactCount", "Equal", 5.0, "Block"), ("gt", "FactCount", "GreaterThan", 4.0, "Warn")])).collect()}
    assert held == {"eq": False, "gt": True}


def test_diff(spark):
    schema = "fingerprint string, file string, line int, severity string, seq long"
    base = spark.createDataFrame([("a", "f", 1, "Minor", 1), ("a", "f", 1, "Major", 2), ("b", "f", 2, "Critical", 3)], schema)
    head = spark.createDataFrame([("a", "f", 1, "Critical", 1), ("a", "f", 1, "Major", 2), ("c", "f", 9, "Info", 3)], schema)
    assert sorted((r.change, r.fingerprint) for r in gov.diff(base, head).collect()) == [("increased", "a"), ("new", "c"), ("resolved", "b")]
    row = gov.diff_summary(base, head).first()
    assert (row.net_change, row.severity_score, row.trend) == (0, 4, "Stable")


def test_diff_of_null_repeated_and_no_findings(spark):
    schema = "fingerprint string, file string, line int, severity string, seq long"
    base = spark.createDataFrame([(None, "f", 1, "Minor", 1), ("a", "f", 1, "Minor", 2), ("a", "f", 2, "Info", None), ("r", "f", 3, "Info", 4), ("r", "f", 3, "Info", 4)], schema)
    head = spark.createDataFrame([(None, "g", 1, "Minor", 1), ("a", "g", 5, "Info", 1), ("a", "g", 5, "Info", 1), ("a", "g", 6, "Minor", 2)], schema)
    told = lambda *sides: sorted((r.change, r.fingerprint or "", r.file, r.line) for r in gov.diff(*sides).collect())
    parts = [("decreased", "a", "g", 5)] * 2 + [("new", "", "g", 1), ("resolved", "", "f", 1)] + [("resolved", "r", "f", 3)] * 2
    assert told(base, head) == parts
    apart = gov.severity_changes(base, head)
    assert sorted((r.change, r.fingerprint, r.file, r.line) for r in apart.collect()) == parts[:2]
    assert told(base.limit(0), head.limit(0)) == [] and {r[0] for r in told(base, base.limit(0))} == {"resolved"} and len(told(base.limit(0), head)) == 4
    assert tuple(gov.diff_summary(base.limit(0), head.limit(0)).first()) == (0, 0, 0, 0, 0, 0, "Stable")


def test_large_diff(spark):
    make = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("fingerprint"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("Info").alias("severity"), F.col("id").alias("seq"))
    row = gov.diff_summary(make(0, 10_000), make(5_000, 15_000)).first()
    assert (row.new, row.resolved) == (5_000, 5_000)


def test_dedup_and_upsert(spark):
    df = few(spark).withColumn("start_column", F.lit(None).cast("int"))
    same = df.union(df.withColumn("fact_id", F.concat(F.lit("z"), "fact_id")).withColumn("message", F.concat(F.lit(" "), F.upper("message"))))
    assert {r.fact_id for r in gov.deduplicated(same, gov.fingerprint(), ["fact_id"]).collect()} == {"v1", "v2", "u1", "u2", "s1"}
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", None), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, gov.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", None), ("c", 4)]


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.reachable(edges, 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert graph.reachable(edges, 77).count() == 0
    assert [r.node for r in graph.shortest_path(edges, 1, 4).collect()] == [1, 2, 3, 4]
    assert graph.shortest_path(edges, 4, 1).count() == 0


def test_unsanitized(spark):
    rows = [("f1", "TaintSource", "n1", "p", None, None, None, None), ("f1", "TaintSink", "n2", None, "run", None, None, None), ("f2", "TaintSource", "n3", "p", None, None, None, None), ("f2", "TaintSink", "n4", None, "run", None, None, None), ("f2", "Sanitization", "n5", None, None, None, "m", True), ("f3", "TaintSink", "n6", None, "run", None, None, None)]
    flows = spark.createDataFrame(rows, "flow_id string, fact_type string, node string, var string, func string, category string, method string, effective boolean")
    assert [tuple(r) for r in graph.unsanitized(flows).collect()] == [("f1", "run", "n1")]


def scans(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out.count("Scan parquet") // 2  # in the tree, and in the details


def test_rules_as_rows(spark):
    rule = Rule("a b", "Vulnerability", "confidence >= 0.9 and severity = 'Critical'", (("UncoveredLine", "true"),), ("file", "start_line"), "High", "{fact.type} {fact.confidence}")
    twin = Rule("two", "Vulnerability", "true", (("UncoveredLine", "message = 'x'"), ("CodeSmell", "true")), ("file",), "Low")
    (row,) = rulebook.evaluate([rule, twin], few(spark)).collect()
    assert (row.rule_name, row.message, row.severity, row.fact_ids) == ("a b", "Vulnerability 0.90", "Major", ["v1"])
    double = few(spark).union(few(spark).where("fact_id = 'u1'"))
    assert rulebook.evaluate([rule], double).count() == 1  # other patterns must hold, however often
    held = rulebook.table(spark, [rule, twin])
    assert {r.name: r for r in rulebook.rules_of(held)} == {"a b": rule, "two": twin}
    with pytest.raises(ValueError, match="share no variable"):
        rulebook.evaluate([Rule("x", "Function", others=(("Variable", "true"),))], few(spark))
    with pytest.raises(ValueError, match="between 1 and"):
        rulebook.rules_of(held.limit(0))
    with pytest.raises(Exception, match="missing"):
        rulebook.evaluate([Rule("n", "CodeSmell", "not (start_line > 5) and missing")], few(spark)).collect()
    with pytest.raises(ValueError, match="unknown field"):
        tx.template("{nothing}")


def test_rule_problems(spark):
    bad = [
        Rule("", "Vulnerability"), Rule("n" * 101, "Vulnerability"), Rule("a/b", "Nothing", severity="Odd"), Rule("t", "Function", others=(("Variable", "true"),)),
        Rule("f", "Function", "foo(file) = 1 and contains(file, 'bar(')"), Rule("s", "Function", "file = '" + "x" * 1001 + "'"), Rule("m", "Function", "file = '{{x}}' or file = '$(rm)'"),
        Rule("d", "Function", "1 = 1; drop"), Rule("same", "Function"), Rule("same", "Function"), Rule("ok", "Function", "file in ('a', 'b') and length(file) > 1"), Rule("g", "Function", "coalesce(" + "1, " * 11 + "1) = 1"),
    ]
    found = [(r.name[:4], r.problems) for r in rulebook.checked(rulebook.table(spark, bad)).collect()]
    assert sorted(found) == sorted([
        ("", ["the name is empty"]), ("nnnn", ["the name is too long"]), ("a/b", ["the name has a path in it", "unknown severity Odd", "unknown fact type Nothing"]), ("t", ["several patterns share no variable"]),
        ("f", ["unknown function foo"]), ("s", ["a text is too long"]), ("m", ["a text has a template in it", "a text has a command in it"]), ("d", ["a condition has a statement in it"]),
        ("same", ["the name is used twice"]), ("same", ["the name is used twice"]), ("ok", []), ("g", ["a function has too many arguments"]),
    ])


def test_a_thousand_rules_of_their_own_names_and_messages(spark):
    many = [Rule(f"r{k}", ("CodeSmell", "Vulnerability")[k % 2], f"start_line >= {k % 7}", severity="High", message=f"{k} {{fact.type}} {{metadata.team}} {{location.file}}!", confidence=k / 1000) for k in range(1000)]
    rows = {(r.rule_name, r.fact_ids[0]): r for r in rulebook.evaluate(many, few(spark)).collect()}
    facts = [r for r in few(spark).collect() if r.fact_type in ("CodeSmell", "Vulnerability")]
    assert rows.keys() == {(f"r{k}", f.fact_id) for k in range(1000) for f in facts if f.fact_type == ("CodeSmell", "Vulnerability")[k % 2] and f.start_line >= k % 7}
    assert all(r.message == f"{n[1:]} {('CodeSmell', 'Vulnerability')[int(n[1:]) % 2]} unknown {r.file}!" and r.confidence == int(n[1:]) / 1000 for (n, _), r in rows.items())
    with pytest.raises(ValueError, match="between 1 and 1000"):
        rulebook.evaluate([*many, Rule("one more", "CodeSmell")], few(spark))


@pytest.mark.parametrize("condition", [
    "message = '\\'' or reflect('java.lang.System', 'getProperty', 'user.home') = '/root'", "message = \"'\" or reflect('a', 'b') = '\"'", "message = r'\\' or reflect('a', 'b') = ' '",
    "`reflect`('a', 'b') = 'c'", "reflect ('a', 'b') = 'c'", "reflect/**/('a', 'b') = 'c'", "message = 'a' 'b' or java_method('a', 'b') = 'c'", "exists(select 1)", "message = 'open",
])
def test_conditions_that_hide_a_call_are_refused(spark, condition):
    with pytest.raises(ValueError, match="x: (unknown function|a condition has|a text has)"):
        rulebook.evaluate([Rule("x", "CodeSmell", condition)], few(spark))


def test_scans_do_not_follow_the_number_of_rules(spark, tmp_path, capsys):
    store.written_by_type(few(spark), str(tmp_path / "facts"))
    df = store.opened(spark, str(tmp_path / "facts"), few(spark).schema)
    many = [Rule(f"r{k}", "CodeSmell", f"start_line = {k}") for k in range(100)]
    paired = [Rule(f"p{k}", "Vulnerability", f"start_line > {k}", (("UncoveredLine", "true"),), ("file",)) for k in range(50)]
    assert scans(rulebook.evaluate(many, df), capsys) == 1
    assert scans(rulebook.evaluate(many + paired, df), capsys) == scans(rulebook.evaluate(many[:1] + paired[:1], df), capsys)
    counts = {r.rule_name: r for r in rulebook.results(many + paired, df, 1).collect()}
    assert (counts["r1"].n_findings, counts["r2"].n_findings, counts["p0"].n_findings, counts["p0"].failed, counts["p20"].n_findings) == (1, 0, 0, True, 1)


def test_catalogue(spark):
    rows = rulebook.catalogue(spark)
    assert rows.count() == 10 and [r.id for r in rulebook.catalogue(spark, category="A03-Injection").collect()] == ["OWASP-A03-001"]
    assert rulebook.catalogue(spark, severity="critical").count() == 5 and rulebook.catalogue(spark, category="none").count() == 0
    found = spark.createDataFrame([("a", "CWE-89"), ("b", "CWE-862"), ("c", "CWE-1"), ("d", None), ("e", "CWE-x")], "fact_id string, cwe_id string")
    assert {(r.fact_id, r.rule_id) for r in rulebook.catalogued(found, rows).collect()} == {("a", "OWASP-A03-001"), ("b", "OWASP-A01-001")}


def test_store_is_pruned_by_type_and_place(spark, tmp_path, capsys):
    store.written_by_type(few(spark), str(tmp_path / "facts"))
    df = store.opened(spark, str(tmp_path / "facts"), few(spark).schema)
    assert df.exceptAll(few(spark)).count() == 0 and df.columns == few(spark).columns
    store.by_location(store.by_type(df, "Vulnerability"), "a.rs", 1, 99).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(fact_type" in plan and "EqualTo(file,a.rs)" in plan and "LessThanOrEqual(start_line,99)" in plan


def test_interned_ids_are_dense(spark):
    df = spark.createDataFrame([(w,) for w in ["b", "a", "c", None, "a", "d", "b"]], "word string")
    assert {(r.value, r.id) for r in store.interned(df, "word").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_first_of_each_fingerprint(spark):
    df = few(spark).withColumn("start_column", F.lit(1))
    rows = gov.deduplicated(df, F.col("file"), ["start_line", "fact_id"]).collect()
    assert {(r.fingerprint, r.fact_id, r.message) for r in rows} == {("a.rs", "u1", "x"), ("b.rs", "s1", "y")}
    narrow = gov.deduplicated(df, F.col("file"), ["start_line", "fact_id"], whole=False)
    assert {(r.fingerprint, r.fact_id) for r in narrow.collect()} == {("a.rs", "u1"), ("b.rs", "s1")}


def test_bulk_update_errors(spark):
    updates = spark.createDataFrame([("p", "f1", "accepted"), ("p", "", "accepted"), ("p", None, "active"), ("p", "f1", "odd"), ("p", "f9", "wontfix"), ("q", "f1", "accepted")], "project string, fingerprint string, status string")
    known = spark.createDataFrame([("p", "f1"), ("p", "f1")], "project string, fingerprint string")
    rows = {r.project: tuple(r)[1:] for r in gov.bulk_updated(updates, known).collect()}
    assert rows == {"p": (5, 1, 4, [": no fingerprint", "f1: unknown status", "f9: unknown finding"]), "q": (1, 0, 1, ["f1: unknown finding"])}


def test_long_chain_of_steps(spark):
    ends = [(k, k + 1) for k in range(20)] + [(0, 2), (0, 3)]
    edges = spark.createDataFrame(ends, "src long, dst long").cache()
    assert {r.node: r.depth for r in graph.reachable(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 1} | {k: k - 2 for k in range(4, 21)}
    assert [r.node for r in graph.shortest_path(edges, 0, 5).orderBy("step").collect()] == [0, 3, 4, 5]
    assert graph.shortest_path(edges, 5, 0).count() == 0 and graph.reachable(edges, 99).count() == 0


def test_caps(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "rule_name string, x int")
    assert {r.rule_name for r in rules.capped(found, 1).collect()} == {"b"}
    assert {(r.rule_name, r.n_findings, r.failed) for r in rules.rule_results(found, ["a", "b", "c"], 1).collect()} == {("a", 0, True), ("b", 1, False), ("c", 0, False)}


def test_registry(spark):
    known = Registry()
    known.register("p:", "1", {"severity": ("string", True), "count": ("number", False)})
    with pytest.raises(ValueError, match="version"):
        known.register("p:", "2", {})
    df = spark.createDataFrame([("p:a", '{"severity": "high", "count": 42}'), ("p:b", '{"count": "x"}'), ("q:c", "{}")], "d string, data string")
    assert [r.v for r in df.select("d", known.violations(F.col("d"), F.col("data")).alias("v")).orderBy("d").collect()] == [[], ["missing field: severity", "wrong type: count"], []]
    assert [r.t for r in spark.createDataFrame([("1",), ('"a"',), ("true",), ("[1]",), ('{"a":1}',), ("no json",)], "j string").select(value_type(F.col("j")).alias("t")).collect()] == ["number", "string", "boolean", "array", "object", None]


def test_durations():
    assert [tx.parse_duration(x) for x in ("500ms", "30s", "5m", "2h")] == [500, 30_000, 300_000, 7_200_000]
    with pytest.raises(ValueError, match="not a duration"):
        tx.parse_duration("5 days")


def test_daily_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    stream = daily_counts(read_events(spark, path, name="events.parquet"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{path}/events.parquet").groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("day"), "event_type").count()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_publish(spark, tmp_path):
    schema = "project string, n long"
    spark.createDataFrame([("a", 1), ("", 2)], schema).write.parquet(str(tmp_path / "in"))
    publish(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), F.length("project") > 0).awaitTermination()
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()] == [1]
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == [2]


def test_rate_limit(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 20)] + [(1, "2024-01-01 00:01:05"), (2, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user long, t string").select("user", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limited(spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in")), "user", 2, 1)
    stream.writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start().awaitTermination()
    assert [r.allowed for r in spark.table("limited").where("user = 1").orderBy("ts").collect()] == [True, True, False, True]


def test_idle_buckets_leave_the_state_and_restarts_go_on(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(rows, "user long, t string").select("user", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rate_limited(spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in")), "user", 2, 1)
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    def held():
        state = spark.read.format("statestore").option("path", str(tmp_path / "at")).option("stateVarName", "bucket").load()
        return sorted(r[0] for r in state.select("key.user").collect())

    arrive((1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00"))
    assert held() == [1, 2]
    arrive((1, "2024-01-01 00:00:30"), (3, "2024-01-01 00:00:40"))  # the bucket of the first run still counts
    arrive((4, "2024-01-01 01:00:00"))
    assert held() == [4]
    arrive((1, "2024-01-01 01:00:10"), (4, "2024-01-01 01:00:11"), (4, "2024-01-01 01:00:12"))
    got = sorted((r.user, str(r.ts), r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [(u, t[11:], a) for u, t, a in got] == [
        (1, "00:00:00", True), (1, "00:00:01", True), (1, "00:00:30", False), (1, "01:00:10", True), (2, "00:00:00", True), (3, "00:00:40", True),
        (4, "01:00:00", True), (4, "01:00:11", True), (4, "01:00:12", False),
    ]
