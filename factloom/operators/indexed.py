"""Rows by their number: a table written in an order, and a manifest that tells which file holds the nth row.

Rows are dealt by ranges and sorted within each, and carry a place that only grows within a file. The manifest has a row a file: how many rows
it holds, how many stand before it, its first place. The nth row is then one file, and one row group or page of it: the place's
statistics let Parquet skip the others. Nothing is sorted or numbered when rows are read, and counts come from the manifest alone.

Defined results: numbers start at 0; a number past the end gives no row, a negative one is an error; an empty table has no files and no
rows; rows that the order leaves alike keep the sequence that they were written in; a column that is called _place is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_PLACE = "_place"


def write(df: DataFrame, path: str, order: list[str], rows_a_file: int = 5_000_000, group_bytes: int = 64 << 20) -> None:
    """df in an order, under path, with its manifest. Ranges follow the data; a file has at most rows_a_file rows."""
    if _PLACE in df.columns:
        raise ValueError(f"a column is called {_PLACE}")
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    ranged.write.option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", group_bytes).parquet(f"{path}/rows")
    stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(_PLACE).alias("place"), F.count("*").alias("n"))
    # One row a file is in this window, not one a row.
    before = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, place, n, before: a row a file."""
    return spark.read.schema("file string, place long, n long, before long").parquet(f"{path}/manifest")


def count(spark: SparkSession, path: str) -> DataFrame:
    """n and files, from the manifest."""
    return manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("files"))


def page(spark: SparkSession, path: str, schema, start: int, rows: int) -> DataFrame:
    """Rows number start to start + rows - 1, with their number; only the files and row groups that hold them are read."""
    if start < 0 or rows < 0:
        raise ValueError("numbers of rows start at 0")
    touched = manifest(spark, path).where((F.col("before") < start + rows) & (F.col("before") + F.col("n") > start)).collect()
    out = spark.createDataFrame([], schema).withColumn("number", F.lit(None).cast("long"))
    for f in touched:
        low, high = f.place + max(0, start - f.before), f.place + min(f.n, start + rows - f.before) - 1
        own = spark.read.schema(StructType([*schema, StructField(_PLACE, LongType())])).parquet(f"{path}/rows/{f.file}")
        own = own.where(F.col(_PLACE).between(low, high)).withColumn("number", F.col(_PLACE) - f.place + f.before)
        out = out.union(own.select(*schema.fieldNames(), "number"))
    return out


def at(spark: SparkSession, path: str, schema, number: int) -> DataFrame:
    """The row with a number: of one file, one row group."""
    return page(spark, path, schema, number, 1).drop("number")
