"""Changed files by a tree of folder digests: folders that are equal in both versions are not looked into.

A tree is stored by depth, each level in ranges of parents. A folder's digest is made from the number of its children and sums of parts of their
SHA-256, so it combines before its shuffle and a folder of a billion files is no list in a task. Two trees are compared from the root
down: of each level only the children of folders that differ are read and joined, so what is compared follows the changes. While few
folders differ, their names go to the scan, which skips row groups; beyond FEW they are semi-joined.

Defined results: of a path that is repeated the greatest hash counts; a null hash is an empty one; null paths are left out; a file and a folder
of one name are two nodes; an empty tree has a root without children, so against it all files are added or deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import shared_path, table

#: Names of folders that go to a scan as a list.
FEW = 1000
_NODE = "parent string, path string, is_file boolean, hash string"


def _parent(path: str) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _digest() -> list[Column]:
    """Columns that are summed into a folder's digest: four parts of 60 bits of each child's SHA-256."""
    child = F.sha2(F.concat_ws("\n", F.col("is_file").cast("string"), "hash", "path"), 256)
    return [F.sum(F.conv(F.substring(child, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(4)]


def _level(spark: SparkSession, path: str, depth: int) -> DataFrame:
    return spark.read.schema(f"{_NODE}, depth int").parquet(f"{path}/levels").where(F.col("depth") == depth).drop("depth")


def write(files: DataFrame, path: str) -> None:
    """The tree of files (path, hash) under path; a job for each level, the deepest first."""
    spark = files.sparkSession
    own = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.coalesce("hash", F.lit(""))).alias("hash"))
    leaves = shared_path(spark, "leaves")
    own.withColumn("depth", F.size(F.split("path", "/"))).write.partitionBy("depth").parquet(leaves)
    staged = spark.read.schema("path string, hash string, depth int").parquet(leaves)
    deepest = staged.agg(F.max("depth")).first()[0] or 0
    folders = spark.createDataFrame([], _NODE)
    for depth in range(deepest, 0, -1):
        found = staged.where(F.col("depth") == depth).select(_parent("path").alias("parent"), "path", F.lit(True).alias("is_file"), "hash")
        found.union(folders).repartitionByRange("parent", "path").sortWithinPartitions("parent", "path").write.parquet(f"{path}/levels/depth={depth}")
        sums = _level(spark, path, depth).groupBy("parent").agg(F.count("*").cast("string").alias("n"), *_digest())
        folders = sums.select(_parent("parent").alias("parent"), F.col("parent").alias("path"), F.lit(False).alias("is_file"), F.sha2(F.concat_ws("-", "n", "s0", "s1", "s2", "s3"), 256).alias("hash"))
    folders.coalesce(1).write.parquet(f"{path}/levels/depth=0")


@dataclass(frozen=True)
class Comparison:
    """changes: path, change (Added, Deleted, Modified); compared: how many nodes of both trees met."""

    changes: DataFrame
    compared: int


def compare(spark: SparkSession, old: str, new: str) -> Comparison:
    out, compared, depth = spark.createDataFrame([], "path string, change string"), 0, 0
    parents: DataFrame | None = None
    while True:
        sides = []
        for side, where in (("old", old), ("new", new)):
            level = _level(spark, where, depth)
            if parents is not None:
                names = [r.path for r in parents.limit(FEW + 1).collect()]
                level = level.where(F.col("parent").isin(names)) if len(names) <= FEW else level.join(parents.select(F.col("path").alias("parent")), "parent", "left_semi")
            sides.append(level.select("path", "is_file", F.col("hash").alias(side)))
        met = table(sides[0].join(sides[1], ["path", "is_file"], "full_outer"), "met")
        compared += met.count()
        differ = met.where(~F.col("old").eqNullSafe(F.col("new")))
        change = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").otherwise("Modified")
        out = out.union(differ.where("is_file").select("path", change.alias("change")))
        parents, depth = differ.where("NOT is_file").select("path"), depth + 1
        if parents.isEmpty():
            return Comparison(out, compared)
