"""Scans of the fact table. Filters reach the Parquet scan; a table written by fact_type is pruned by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.checkpoints import cut

#: Average bytes that the statistics assume for a fact. Fixed value.
FACT_BYTES = 64

#: Facts that a task of the store's writer takes: with their ids and messages about 1 GB before compression.
FILE_ROWS = 4_000_000


def by_type(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact_type").isin(*kinds))


def by_file(facts: DataFrame, file: str) -> DataFrame:
    return facts.where(F.col("file") == file)


def by_location(facts: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """Facts whose lines overlap start..end, both ends included."""
    return facts.where((F.col("file") == file) & (F.col("start_line") <= end) & (F.col("end_line") >= start))


def by_flow(facts: DataFrame, flow: str) -> DataFrame:
    return facts.where(F.col("flow_id") == flow)


def by_custom(custom: DataFrame, discriminant: Column) -> DataFrame:
    return custom.where(discriminant)


def matching(facts: DataFrame, kind: str, **values) -> DataFrame:
    """One type, and equal values in named columns."""
    out = by_type(facts, kind)
    for name, value in values.items():
        out = out.where(F.col(name) == value)
    return out


def at_index(facts: DataFrame, order: list[str], n: int) -> DataFrame:
    """The nth row (from 0) in an order; a top-n selection, no numbering of the whole table."""
    return facts.orderBy(*order).offset(n).limit(1)


def type_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_type").agg(F.count("*").alias("n"), (F.count("*") * FACT_BYTES).alias("bytes"))


def file_statistics(facts: DataFrame) -> DataFrame:
    """Facts a file, its line range and facts per line of it."""
    span = F.max("end_line") - F.min("start_line") + 1
    return facts.groupBy("file").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.round(F.count("*") / span, 6).alias("density"))


def flow_statistics(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("flow_id").isNotNull()).groupBy("flow_id").agg(F.count("*").alias("n"))


def duplicate_ids(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def interned(facts: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with dense ids from 0 by value. A range sort orders them; each range counts its own, and the
    counts of the ranges, a row a task, are summed up: no window runs over all values."""
    values = facts.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranged = values.repartitionByRange("value").sortWithinPartitions("value")
    placed = cut(ranged.select("value", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth")))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select("range", before.alias("before")), "range").select("value", (F.col("before") + F.col("nth")).alias("id"))


def written_by_type(facts: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """The store's layout: a directory a type, in it files that each hold a stretch of places in order, so that files and row groups are
    skipped. Their number follows the table (about `rows` facts a task): the ranges are cut from a sample of all keys, so a type or a
    file with a third of all facts is dealt to as many tasks as it needs. Counting reads footers alone where facts are a projection."""
    least = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [c for c in ("fact_type", "file", "start_line", "fact_id") if c in facts.columns]
    facts.repartitionByRange(max(least, -(-facts.count() // rows)), *place).sortWithinPartitions(*place).write.partitionBy("fact_type").parquet(path)


def opened(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store at a path, with the columns of schema in their order."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
