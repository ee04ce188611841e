"""Tables that change by deltas: equal to a plain dictionary, and only touched buckets are written and rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import versioned

SCHEMA = "k long, name string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_equal_a_dictionary_and_versions_stay(spark, tmp_path):
    rng, path = random.Random(7), str(tmp_path / "t")
    state = {k: (k, f"n{k}", 0) for k in range(200)}
    first = versioned.create(frame(spark, list(state.values())), path, ["k"], rows_a_bucket=20)
    assert first.buckets == 10
    for step in range(4):
        new = [(rng.randint(0, 260), rng.choice(["a", "b", None]), rng.randint(0, 9)) for _ in range(30)]
        gone = [(rng.randint(0, 260), None, None) for _ in range(5)]
        best = {}
        for r in new:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda r: (r[2], r[1] is not None, r[1] or ""))
        state |= best
        if step % 2:
            for g in gone:
                state.pop(g[0], None)
        versioned.change(spark, path, frame(spark, new), ["v"], frame(spark, gone) if step % 2 else None)
        assert sorted(map(tuple, versioned.current(spark, path).collect()), key=str) == sorted(state.values(), key=str)
    compacted = versioned.compact(spark, path, most=2)
    assert all(v == 0 for b, v, _ in compacted.files if sum(x[0] == b for x in compacted.files) == 1)
    assert sorted(map(tuple, versioned.current(spark, path).collect()), key=str) == sorted(state.values(), key=str)
    assert versioned.current(spark, path, first).count() == 200  # an earlier version is still there
    assert versioned.compact(spark, path, most=2) == compacted


def test_only_touched_buckets_are_written_and_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    first = versioned.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("n").alias("name"), F.lit(0).cast("long").alias("v")), path, ["k"], rows_a_bucket=50)
    m = versioned.change(spark, path, frame(spark, [(3, "x", 1), (3, "y", 0)]), ["v"])
    added = set(m.files) - set(first.files)
    assert len(added) == 1 and set(first.files) < set(m.files)
    (bucket, _, folder) = next(iter(added))
    assert [tuple(r) for r in spark.read.parquet(folder).select("k", "name", "v").collect()] == [(3, "x", 1)]  # nothing else of the bucket was copied
    files = versioned.current(spark, path).inputFiles()
    assert len(files) == 21
    after = versioned.compact(spark, path, most=1)
    assert {f for f in after.files if f[0] != bucket} == {f for f in first.files if f[0] != bucket}
    assert spark.read.parquet(next(f[2] for f in after.files if f[0] == bucket)).count() == spark.read.parquet(f"{first.files[0][2]}/_bucket={bucket}").count()
    assert versioned.current(spark, path).where("k = 3").first().name == "x" and versioned.current(spark, path).count() == 1000


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(frame(spark, [(1, "a", 1)]), path, ["k"])
    broken = frame(spark, [(1, "b", 2), (2, "c", 3)]).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        versioned.change(spark, path, broken)
    assert [tuple(r) for r in versioned.current(spark, path).collect()] == [(1, "a", 1)]
    m = versioned.latest(spark, path)
    versioned.change(spark, path, frame(spark, [(1, "d", 4)]))
    with pytest.raises(Exception, match="EXIST"):  # a writer that started from the same manifest
        versioned._commit(spark, path, versioned.Manifest(m.number + 1, m.keys, m.buckets, m.schema, m.files))
    versioned.change(spark, path, deleted=frame(spark, [(1, None, None), (9, None, None)]))
    assert versioned.current(spark, path).count() == 0 and versioned.current(spark, path).dtypes == [("k", "bigint"), ("name", "string"), ("v", "bigint")]


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(frame(spark, []), path, ["k"])
    assert versioned.current(spark, path).count() == 0
    versioned.change(spark, path, frame(spark, []))
    versioned.change(spark, path, frame(spark, [(5, "n", 1)]))
    assert [tuple(r) for r in versioned.current(spark, path).collect()] == [(5, "n", 1)]
