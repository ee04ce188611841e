"""Storing in one transaction: whole runs or nothing."""

import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.sources.transaction import Transaction


@pytest.fixture
def db(spark, tmp_path):
    spark.dataSource.register(Transaction)
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE analyses (id INTEGER PRIMARY KEY, project TEXT)")
    return path


def store(df, db, run, n):
    df.write.format("transaction").options(module="sqlite3", url=db, table="findings", run=run, header=f'{{"id": {n}, "project": "p"}}', headertable="analyses").mode("append").save()


def asked(db, sql):
    con = sqlite3.connect(db)
    try:
        return con.execute(sql).fetchall()
    finally:
        con.close()


def rows(spark, n=5000, parts=4):
    return spark.range(n).select("id", F.concat(F.lit("f"), "id").alias("name"), (F.col("id") / 2).alias("score"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("line")).repartition(parts)


def tables(db):
    return {r[0] for r in asked(db, "SELECT name FROM sqlite_master WHERE type = 'table'")}


def test_a_run_is_stored_with_its_header_once(spark, db):
    store(rows(spark), db, "one", 1)
    store(rows(spark), db, "one", 1)  # repeated: nothing is added
    assert asked(db, "SELECT count(*), count(DISTINCT id), sum(score), count(line) FROM findings") == [(5000, 5000, 6248750.0, 2500)]
    assert asked(db, "SELECT * FROM analyses") == [(1, "p")] and asked(db, "SELECT * FROM findings_runs") == [("one", 5000)]
    store(rows(spark, 10), db, "two", 2)
    store(rows(spark, 0), db, "none", 3)
    assert asked(db, "SELECT count(*) FROM findings") == [(5010,)] and tables(db) == {"analyses", "findings", "findings_runs"}
    back = spark.read.format("transaction").schema("id long, name string, score double, line int").options(module="sqlite3", url=db, table="findings", by="id", parts="3").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows(spark).union(rows(spark, 10)).collect()))


def test_a_failing_task_leaves_nothing_behind(spark, db):
    store(rows(spark, 10), db, "before", 1)
    broken = rows(spark, 6000, 3).withColumn("line", F.when(F.col("id") == 5999, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        store(broken, db, "broken", 2)
    assert asked(db, "SELECT count(*) FROM findings") == [(10,)] and asked(db, "SELECT id FROM analyses") == [(1,)]
    assert tables(db) == {"analyses", "findings", "findings_runs"}


def test_a_failing_commit_leaves_nothing_behind(spark, db):
    store(rows(spark, 10), db, "before", 1)
    with pytest.raises(Exception, match="UNIQUE"):
        store(rows(spark), db, "same header", 1)
    assert asked(db, "SELECT count(*) FROM findings") == [(10,)] and asked(db, "SELECT run FROM findings_runs") == [("before",)]
    store(rows(spark), db, "same header", 4)
    assert asked(db, "SELECT count(*) FROM findings") == [(5010,)]


def test_names_are_checked_and_overwriting_is_refused(spark, db):
    with pytest.raises(Exception, match="no plain name"):
        rows(spark).write.format("transaction").options(module="sqlite3", url=db, table="a; drop table analyses", run="x").mode("append").save()
    with pytest.raises(Exception, match="append"):
        rows(spark).write.format("transaction").options(module="sqlite3", url=db, table="findings", run="x").mode("overwrite").save()


def test_a_restarted_stream_gives_each_row_once(spark, db, tmp_path):
    from factloom.streaming import fanned_out, received

    schema = rows(spark).schema

    def run(fails=False):
        found = spark.readStream.format("transaction").schema("id long, name string, score double, line int").options(module="sqlite3", url=db, table="findings", by="id", parts="3").load()
        if fails:
            found = found.withColumn("line", F.when(F.col("id") == 199, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("line")))
        fanned_out(found.withColumn("project", F.concat(F.lit("p"), F.col("id") % 3)), str(tmp_path / "out"), str(tmp_path / "at"), "project").awaitTermination()

    sent = lambda *value: received(spark, str(tmp_path / "out"), schema.add("project", "string") if "project" not in schema.names else schema, "project", *value)
    store(rows(spark, 100), db, "one", 1)
    run()
    assert sent().count() == 100 and sent("p1").count() == 33
    store(rows(spark, 200).where("id >= 100"), db, "two", 2)
    with pytest.raises(Exception, match="lost"):
        run(fails=True)
    run()  # the batch that failed runs again
    run()  # and with nothing new, none
    assert sorted(r.id for r in sent().collect()) == list(range(200))
    assert sorted(r.id for r in sent("p2").collect()) == [k for k in range(200) if k % 3 == 2]
    plan = sent("p2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "p2" in plan.split("PartitionFilters")[1].split("]")[0]


def beside(db):
    return sorted(f.name for f in Path(db).parent.glob("store.db*"))


def test_tasks_do_not_write_to_the_database_of_one_writer(spark, db):
    store(rows(spark, 5000, 20), db, "one", 1)  # more tasks than files that are attached at once
    assert asked(db, "SELECT count(*), count(DISTINCT id), sum(score), count(line) FROM findings") == [(5000, 5000, 6248750.0, 2500)] and beside(db) == ["store.db"]
    before = Path(db).read_bytes()
    broken = rows(spark, 6000, 12).withColumn("line", F.when(F.col("id") == 5999, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        store(broken, db, "broken", 2)
    assert Path(db).read_bytes() == before and beside(db) == ["store.db"]
    with pytest.raises(Exception, match="UNIQUE"):
        store(rows(spark), db, "same header", 1)
    assert asked(db, "SELECT count(*) FROM findings") == [(5000,)] and beside(db) == ["store.db"]


def test_reading_and_streaming_look_at_each_row_once(spark, db):
    store(rows(spark, 5000), db, "one", 1)
    source = Transaction({"module": "sqlite3", "url": db, "table": "findings", "by": "id", "parts": "5"})
    parts = [source.reader(rows(spark).schema).partitions(), source.streamReader(rows(spark).schema).partitions({"done": 99}, {"done": 4999})]
    for some, n in zip(parts, (5000, 4900), strict=True):
        assert len(some) == 5 and sum(asked(db, f"SELECT count(*) FROM findings WHERE {p.where}")[0][0] for p in some) == n
        assert all("SEARCH findings USING INTEGER PRIMARY KEY" in asked(db, f"EXPLAIN QUERY PLAN SELECT name FROM findings WHERE {p.where}")[0][3] for p in some)


@pytest.mark.parametrize("table", ["plain", "view", "without numbers", "own numbers", "other columns", "empty"])
def test_tables_of_other_makers_are_read_whole(spark, db, table):
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE made (id BIGINT, name TEXT, score DOUBLE PRECISION, line INTEGER)" if table != "without numbers" else "CREATE TABLE made (id BIGINT PRIMARY KEY, name TEXT, score DOUBLE PRECISION, line INTEGER) WITHOUT ROWID")
        if table == "own numbers":
            con.execute("ALTER TABLE made ADD COLUMN rowid BIGINT")
        if table == "other columns":
            con.execute("CREATE TABLE findings (extra TEXT, line INTEGER, name BLOB, score DOUBLE PRECISION, id BIGINT)")
        found = [(k, f"n{k}", k / 3, None if k % 2 else k) for k in range(-5, 40)] if table != "empty" else []
        con.executemany("INSERT INTO made (id, name, score, line) VALUES (?, ?, ?, ?)", found + ([(None, "unnumbered", None, 7)] if table in ("plain", "own numbers") else []))
        con.execute("CREATE VIEW seen AS SELECT * FROM made")
    if table == "other columns":
        store(rows(spark, 100).withColumn("name", F.col("id").cast("string")), db, "one", 1)
    name = {"view": "seen", "other columns": "findings"}.get(table, "made")
    back = spark.read.format("transaction").schema("id long, name string, score double, line int").options(module="sqlite3", url=db, table=name, by="id", parts="3").load()
    wanted = asked(db, f"SELECT id, name, score, line FROM {name}")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, wanted)) and len(wanted) == {"empty": 0, "other columns": 100, "plain": 46, "own numbers": 46}.get(table, 45)


def test_other_modules_stage_in_the_database(spark, db):
    def save(df, run):
        df.write.format("transaction").options(module="sqlite3.dbapi2", url=db, table="findings", run=run).mode("append").save()

    save(rows(spark, 3000, 1), "one")
    save(rows(spark, 3000, 1), "one")
    assert asked(db, "SELECT count(*), sum(score), count(line) FROM findings") == [(3000, 2249250.0, 1500)] and tables(db) == {"analyses", "findings", "findings_runs"}
    back = spark.read.format("transaction").schema("id long, name string, score double, line int").options(module="sqlite3.dbapi2", url=db, table="findings", by="id").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows(spark, 3000).collect()))


def test_times_and_nulls_are_stored_as_before(spark, db):
    df = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2001-02-03 04:05:06', true, 'a'), (2L, NULL, NULL, NULL) t(id, at, ok, name)")
    df.write.format("transaction").options(module="sqlite3", url=db, table="findings", run="one").mode("append").save()
    assert asked(db, "SELECT * FROM findings ORDER BY id") == [(1, "2001-02-03 04:05:06", 1, "a"), (2, None, None, None)]
