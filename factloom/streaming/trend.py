"""A daily trend that is kept up to date by a stream: partial sums of each micro-batch, merged when they are read and folded in turn.

A micro-batch leaves one small table of sums by day and keys, in a directory by its number; one that runs again after a failure replaces
its own, so each row counts once. A late row adds to its day whenever it comes: no watermark drops it, and no state is held. A row may
carry a weight, so a correction is a row of negative weight. Readers add up the base and the sums after it, which are as many as days, keys
and batches, never as many as events. Folding adds the sums so far into a new base and then names it, in this order, so that readers see
either the old base with its sums or the new one; sums that a base holds are skipped by their directories.

Defined results: rows without a time count on a null day, null keys are keys; a day whose weights add up to 0 is left out; an empty stream
gives no rows. Fold while no other fold runs; the stream may run meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

_NONE = -1


def _schema(events: StructType, keys: list[str]) -> StructType:
    return StructType([StructField("day", TimestampNTZType()), *[StructField(k, events[k].dataType) for k in keys], StructField("n", LongType())])


def _sums(rows: DataFrame, keys: list[str], weight: str | Column) -> DataFrame:
    weight = F.col(weight) if isinstance(weight, str) else weight
    return rows.groupBy("day", *keys).agg(F.sum(weight).cast("long").alias("n"))


def _made(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty base and an empty batch under the number -1, unless they are there."""
    none = spark.createDataFrame([], schema)
    for where in ("sums/batch", "bases/through"):
        none.write.mode("ignore").parquet(f"{path}/{where}={_NONE}")
    spark.createDataFrame([(_NONE,)], "last long").coalesce(1).write.mode("ignore").parquet(f"{path}/folded/fold={_NONE}")


def kept(events: DataFrame, path: str, checkpoint: str, keys: list[str], time: str = "ts", weight: Column | None = None) -> StreamingQuery:
    """Start to keep the trend of a stream of events under path; it ends when all that is there has been read."""
    _made(events.sparkSession, path, _schema(events.schema, keys))
    each = F.lit(1) if weight is None else weight

    def add(batch: DataFrame, number: int) -> None:
        dated = batch.select(F.date_trunc("day", F.col(time)).cast("timestamp_ntz").alias("day"), *keys, each.alias("_weight"))
        _sums(dated, keys, "_weight").coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, path: str) -> int:
    return spark.read.schema("last long").parquet(f"{path}/folded").agg(F.max("last")).first()[0]


def _so_far(spark: SparkSession, path: str, schema: StructType, keys: list[str], through: int | None = None) -> DataFrame:
    last = _last(spark, path)
    base = spark.read.schema(schema).parquet(f"{path}/bases/through={last}")
    later = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/sums").where(F.col("batch") > last)
    later = later if through is None else later.where(F.col("batch") <= through)
    return _sums(base.union(later.drop("batch")), keys, "n")


def trend(spark: SparkSession, path: str, events: StructType, keys: list[str]) -> DataFrame:
    """day, keys, n: the trend as it stands; events is the schema of the stream's rows."""
    return _so_far(spark, path, _schema(events, keys), keys).where(F.col("n") != 0)


def fold(spark: SparkSession, path: str, events: StructType, keys: list[str], through: int) -> None:
    """Add the sums of all batches up to a finished one into a new base. Folding what is folded does nothing."""
    if through <= _last(spark, path):
        return
    _so_far(spark, path, _schema(events, keys), keys, through).write.mode("overwrite").parquet(f"{path}/bases/through={through}")
    spark.createDataFrame([(through,)], "last long").coalesce(1).write.mode("overwrite").parquet(f"{path}/folded/fold={through}")
