"""Many patterns in one scan, rows by their number, and the kept trend: defined cases, plain versions, and what is read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import indexed, phrases
from factloom.streaming import trend

SCHEMA = "doc_id long, lang string, text string"


def plain_places(texts, patterns):
    """Every pattern at every token, compared token by token."""
    out = []
    for doc, lang, text in texts:
        spans = list(re.finditer(phrases.TOKEN, text or ""))
        tokens = [m.group() for m in spans]
        for rule, language, pattern in patterns:
            parts = re.findall(r"\$(?:[A-Z][A-Z0-9_]*|_)|" + phrases.TOKEN, pattern)
            for at in range(len(tokens) - len(parts) + 1) if language in (None, lang) else ():
                held = {}
                if all(t == p if not re.fullmatch(r"\$(?:[A-Z][A-Z0-9_]*|_)", p) else p == "$_" or held.setdefault(p[1:], t) == t for p, t in zip(parts, tokens[at:])):
                    out.append((doc, rule, text.count("\n", 0, spans[at].start()) + 1, at, tuple(sorted(held.items()))))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.rule, r.line, r.start, tuple(sorted(r.bound.items()))) for r in df.collect())


@pytest.mark.parametrize("a_pass", [50_000, 300])
def test_a_thousand_patterns_equal_a_plain_search(spark, monkeypatch, a_pass):
    monkeypatch.setattr(phrases, "PASS", a_pass)
    rng = random.Random(5)
    words = ["if", "x", "y", "é_1", "(", ")", "=", "$", "==", "run", "a"]
    texts = [(k, rng.choice(["py", "js", None]), rng.choice([" ", "\n", "  \n"]).join(rng.choices(words, k=rng.randrange(60)))) for k in range(40)]
    texts += [(100, "py", None), (101, "py", ""), (102, "py", "x = x " * 300)]
    patterns = {}
    while len(patterns) < 1000:
        parts = rng.choices([*words[:-1], "$A", "$B", "$A", "$_"], k=rng.randrange(1, 6))
        if any(not p.startswith("$") or p == "$" for p in parts) and not any(p == "$" and q[:1].isalpha() for p, q in zip(parts, parts[1:])):
            patterns[" ".join(parts)] = rng.choice([None, None, "py", "js"])
    rules = [(f"r{k}", lang, p) for k, (p, lang) in enumerate(patterns.items())]
    got = phrases.places(spark.createDataFrame(texts, SCHEMA).repartition(3), spark.createDataFrame(rules, "rule string, language string, pattern string"))
    assert found(got) == plain_places(texts, rules)


def test_patterns_defined_cases(spark):
    texts = spark.createDataFrame([("k", None, "eval(x, x); eval(x,\n y)")], "name string, lang string, text string")
    schema = "rule string, language string, pattern string"
    rules = spark.createDataFrame([("same", None, "eval($X, $X)"), ("any", None, "eval($X, $XY)"), ("other", "py", "eval")], schema)
    got = phrases.places(texts, rules, key="name")
    facts = phrases.facts(got, spark.createDataFrame([("same", "security", "error", "twice $X"), ("any", "layout", "info", "$X and $XY, $Z")], "rule string, category string, level string, message string"), key="name")
    assert sorted((r.rule, r.fact_type, r.message, r.line) for r in facts.collect()) == [("any", "CodeSmell", "x and x, $Z", 1), ("any", "CodeSmell", "x and y, $Z", 1), ("same", "Vulnerability", "twice x", 1)]
    assert phrases.places(texts, rules.limit(0), key="name").count() == 0 and phrases.places(texts.limit(0), rules, key="name").count() == 0
    for wrong in ([("v", None, "$A $B")], [("v", None, "a"), ("v", None, "b")], [("v", None, None)]):
        with pytest.raises(ValueError):
            phrases.places(texts, spark.createDataFrame(wrong, schema), key="name")


def test_many_patterns_need_no_shuffle_and_no_join(spark, capsys):
    texts = spark.createDataFrame([(1, None, "a b")], SCHEMA)
    capsys.readouterr()
    phrases.places(texts, spark.createDataFrame([(f"r{k}", None, f"a{k}") for k in range(1000)], "rule string, language string, pattern string")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def rows_of_scan(df):
    """Rows that the scans of a plan without exchanges gave."""
    df._jdf.collectToPython()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()) if "FileScan" in leaves.apply(k).toString())


def test_the_nth_row_is_read_from_one_row_group(spark, tmp_path):
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = str(tmp_path / "t")
    indexed.write(df.repartition(5), path, ["n"], rows_a_file=9_000, group_bytes=64_000)
    files = indexed.manifest(spark, path).orderBy("before").collect()
    assert sum(f.n for f in files) == 60_000 and len(files) >= 7 and max(f.n for f in files) <= 9_000
    for n in (0, 8_999, 9_000, 41_234, 59_999):
        row = indexed.at(spark, path, df.schema, n)
        assert [r.n for r in row.collect()] == [n] and len(row.inputFiles()) == 1
    assert 0 < rows_of_scan(indexed.at(spark, path, df.schema, 41_234)) < 4_000
    page = indexed.page(spark, path, df.schema, 8_500, 2_000)
    assert [(r.number, r.n) for r in page.orderBy("number").collect()] == [(k, k) for k in range(8_500, 10_500)] and len(page.inputFiles()) <= 3
    assert indexed.count(spark, path).first().n == 60_000
    assert indexed.at(spark, path, df.schema, 60_000).count() == 0
    with pytest.raises(ValueError):
        indexed.at(spark, path, df.schema, -1)


def test_indexed_table_of_nulls_ties_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 1), (None, 2), (1, None)], "k long, file long")
    indexed.write(df, str(tmp_path / "a"), ["k"])
    assert [r.k for r in indexed.page(spark, str(tmp_path / "a"), df.schema, 0, 9).orderBy("number").collect()] == [None, None, 1, 2, 2]
    indexed.write(df.limit(0), str(tmp_path / "b"), ["k"])
    assert indexed.count(spark, str(tmp_path / "b")).first().n == 0 and indexed.at(spark, str(tmp_path / "b"), df.schema, 0).count() == 0
    with pytest.raises(ValueError):
        indexed.write(df.withColumn("_place", F.lit(1)), str(tmp_path / "c"), ["k"])


def test_kept_trend_corrects_late_rows_and_replaces_batches_that_run_again(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, w int"
    days = [("2024-01-05 10:00:00", "a", 1), ("2024-01-06 10:00:00", "a", 1), (None, None, 1)]
    late = [("2024-01-05 23:59:59", "a", 1), ("2024-01-06 00:00:00", "a", -1)]
    write = lambda rows, name: spark.createDataFrame(rows, "ts string, kind string, w int").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    own, at = str(tmp_path / "trend"), str(tmp_path / "at")
    run = lambda checkpoint=at: trend.kept(stream(), own, checkpoint, ["kind"], weight=F.col("w")).awaitTermination()
    read = lambda: sorted((str(r.day)[:10], r.kind or "", r.n) for r in trend.trend(spark, own, stream().schema, ["kind"]).collect())
    write(days, "1")
    run()
    first = [("2024-01-05", "a", 1), ("2024-01-06", "a", 1), ("None", "", 1)]
    assert read() == first
    run(str(tmp_path / "lost"))  # the checkpoint is lost, so batch 0 runs again
    assert read() == first
    trend.fold(spark, own, stream().schema, ["kind"], 0)
    assert read() == first
    write(late, "2")
    run()
    merged = [("2024-01-05", "a", 2), ("None", "", 1)]
    assert read() == merged
    spark.createDataFrame([], "day timestamp_ntz, kind string, n long").write.parquet(f"{own}/bases/through=1")  # a fold that failed before it was named
    assert read() == merged
    trend.fold(spark, own, stream().schema, ["kind"], 1)
    trend.fold(spark, own, stream().schema, ["kind"], 0)
    assert read() == merged
