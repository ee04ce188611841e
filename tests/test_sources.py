import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import reports, texts

def result(rule, level=None, text="t", file=None, region=None, **properties):
    place = {"artifactLocation": {"uri": file}} | ({"region": region} if region else {})
    return {"ruleId": rule, "message": {"text": text}} | ({"level": level} if level else {}) | ({"locations": [{"physicalLocation": place}]} if file else {}) | ({"properties": properties} if properties else {})


RUNS = [
    [result("go/raw-query", "error", file="pkg/store.go", region={"startLine": 7, "startColumn": 0}, cwe=["CWE-564"], tags=["external/security"], **{"security-severity": 6.5}), result("indent", file="pkg/b.go")],
    [],
    [result("quoted", "note", **{"security-severity": "6.5"})],
]
REPORT = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": f"tool{k}"}}, "results": r} for k, r in enumerate(RUNS)]}


def test_reports(spark, tmp_path):
    (tmp_path / "one.sarif").write_text(json.dumps(REPORT, indent=1))
    (tmp_path / "other.txt").write_text("no report")
    rows = {r.rule: r for r in reports.report_facts(reports.read_reports(spark, str(tmp_path))).collect()}
    query, indent, quoted = (rows[k] for k in ("go/raw-query", "indent", "quoted"))
    assert (query.fact_type, query.severity, query.cwe_id, query.confidence) == ("Vulnerability", "Critical", "CWE-564", 0.65)
    assert (query.start_line, query.end_line, query.start_column) == (7, 7, None)
    assert (indent.fact_type, indent.severity, indent.start_line) == ("CodeSmell", "Major", 1)
    assert (quoted.fact_type, quoted.confidence, quoted.file) == ("Vulnerability", 0.5, "unknown")
    with pytest.raises(Exception, match="no region"):
        reports.adapter_facts(reports.read_reports(spark, str(tmp_path))).collect()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.json").write_text(json.dumps(REPORT) + "\n" + json.dumps(REPORT))
    assert reports.report_facts(reports.read_reports(spark, str(tmp_path / "lines"), lines=True)).count() == 6


def test_linter_file(spark, tmp_path):
    (tmp_path / "ruff.json").write_text(json.dumps([{"filename": "/p/a.py", "code": "F1", "message": "m", "severity": "error", "line": 3, "column": 2}]))
    (row,) = reports.linter_facts(reports.read_linter(spark, str(tmp_path)), "/p").collect()
    assert (row.file, row.severity, row.owasp_category, row.message, row.end_line) == ("a.py", "Critical", "ruff-F1", "[F1] m", 3)


def test_coverage_xml(spark, tmp_path):
    line = '<line nr="{}" mi="{}" ci="{}" mb="0" cb="0"/>'
    seen = "".join(line.format(*x) for x in ((3, 0, 5), (4, 1, 3), (5, 0, 0), (6, 2, 0)))
    (tmp_path / "cover.xml").write_text(f'<report name="r"><package name="org.lab"><class name="org.lab.Tool" sourcefilename="Tool.java"><method name="go" desc="()V" line="3">{seen}</method></class></package></report>')
    lines = reports.read_coverage(spark, str(tmp_path / "cover.xml"))
    assert sorted((r.file, r.start_line) for r in reports.uncovered(lines).collect()) == [("org/lab/Tool.java", 4), ("org/lab/Tool.java", 5), ("org/lab/Tool.java", 6)]
    assert [r.percent for r in reports.line_coverage(lines).orderBy("nr").collect()] == [100.0, 75.0, 0.0, 0.0]


def test_fact_files(spark, tmp_path):
    schema = "fact_id string, file string, start_line int"
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], schema)
    texts.write_facts(df, str(tmp_path / "facts"))
    assert texts.read_facts(spark, str(tmp_path / "facts"), schema).exceptAll(df).count() == 0
    rows = [r.asDict() for r in df.collect()]
    for name, held in (("bare.json", rows), ("facts.json", {"facts": rows}), ("findings.json", {"findings": rows})):
        (tmp_path / name).write_text(json.dumps(held))
        assert sorted(r.fact_id for r in texts.read_facts(spark, str(tmp_path / name), schema).collect()) == ["a", "b"], name
    (tmp_path / "f.yaml").write_text("facts:\n- {fact_id: a, file: x, start_line: 1}\n")
    assert texts.read_facts(spark, str(tmp_path / "f.yaml"), schema).count() == 1


def test_rules_and_config():
    config = texts.load_config('[[extractors]]\nname = "a"\ntimeout = "30s"\n', '[[extractors]]\nname = "a"\ntimeout = "5m"\nenabled = true\n[[extractors]]\nname = "b"\n')
    assert config == {"a": {"name": "a", "timeout_ms": 30_000, "enabled": True}, "b": {"name": "b"}}
    with pytest.raises(ValueError, match="without pattern"):
        texts.load_rules("rules: [{id: x, language: python}]")
    ours = texts.translate_rule({"id": "r", "patterns": [{"pattern": "eval($X)"}, {"pattern": "exec($X)"}], "languages": ["python"], "severity": "ERROR"})
    assert (ours["patterns"], ours["severity"], ours["language"]) == (["eval($X)", "exec($X)"], "error", "python")


def test_todo_lines(spark):
    df = spark.createDataFrame([(1, "a\n// TODO x\nTODO"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.line) for r in texts.marked_lines(texts.lines(df)).orderBy("line").collect()] == [(1, 2), (1, 3)]
    assert [r.x for r in spark.createDataFrame([("a.py",), ("b",)], "p string").select(texts.language(F.col("p")).alias("x")).collect()] == ["python", "unknown"]


def test_external_extractors(spark):
    import sys

    from factloom.sources.extractor import ExtractorSource, totals

    spark.dataSource.register(ExtractorSource)
    code = "import json, sys; c = json.load(sys.stdin); print(json.dumps({'facts': [{'fact_type': 'CodeSmell', 'file': c['file'], 'start_line': 1}]}))"
    commands = [{"name": "one", "command": [sys.executable, "-c", code], "config": {"file": "a.py"}}, {"name": "two", "command": ["/no/such/tool"]}]
    df = spark.read.format("extractor").option("commands", json.dumps(commands)).load()
    assert sorted((r.extractor, r.facts, r.failed) for r in totals(df).collect()) == [("one", 1, False), ("two", 0, True)]
    with pytest.raises(Exception, match="all extractors failed"):
        totals(df.where("extractor = 'two'")).collect()


def test_store(spark, tmp_path):
    from factloom.operators.model import store_findings

    df = spark.createDataFrame([("p", 1), ("q", 2)], "project string, x int")
    store_findings(df, str(tmp_path / "s"))
    store_findings(df.where("x = 1"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("project = 'p'").count() == 2
