"""Changed files by folder digests: equal to the full join, and compared only where folders differ."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import folders
from factloom.operators.governance import changes


def listed(df):
    return sorted((r.path, r.change) for r in df.collect())


def compared(spark, tmp_path, old, new, name="t"):
    paths = [str(tmp_path / f"{name}-{k}") for k in range(2)]
    for df, path in zip((old, new), paths):
        folders.write(df, path)
    return folders.compare(spark, *paths)


@pytest.mark.parametrize("few", [1000, 1])
def test_equal_to_the_full_join_and_rows_follow_the_changes(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(folders, "FEW", few)
    files = spark.range(20_000).select(F.expr("concat_ws('/', 'r', id % 4, id % 100, id)").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    new = files.where("path NOT LIKE '%/1007'").withColumn("hash", F.when(F.col("path").endswith("/2011"), "x").otherwise(F.col("hash")))
    new = new.union(spark.createDataFrame([("r/9/new/file", "h"), ("top", "h")], "path string, hash string"))
    done = compared(spark, tmp_path, files, new)
    assert listed(done.changes) == listed(changes(files, new))
    assert done.compared < 700
    same = folders.compare(spark, str(tmp_path / "t-0"), str(tmp_path / "t-0"))
    assert same.compared == 1 and same.changes.count() == 0


def test_nulls_repeats_names_and_empty_trees(spark, tmp_path):
    schema = "path string, hash string"
    old = spark.createDataFrame([("a", "1"), ("a/b", "1"), ("/c", None), (None, "1"), ("it's/x", "1"), ("it's/x", "2"), ("d/e/f", "1")], schema)
    new = spark.createDataFrame([("a", "2"), ("a/b", "1"), ("/c", ""), ("it's/x", "2"), ("d/e", "1")], schema)
    assert listed(compared(spark, tmp_path, old, new).changes) == [("a", "Modified"), ("d/e", "Added"), ("d/e/f", "Deleted")]
    assert listed(compared(spark, tmp_path, old.limit(0), new, "e").changes) == [(p, "Added") for p in sorted(["a", "a/b", "/c", "it's/x", "d/e"])]
    assert compared(spark, tmp_path, old.limit(0), old.limit(0), "n").changes.count() == 0
