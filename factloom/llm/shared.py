"""Helpers that the operators of this folder have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import shared_path

#: Text bytes that a task turns into numpy arrays at once (one document more at most).
SLICE_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read from there: its lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, table: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """rows left-joined with table (a row a key) in `salts` tasks a key, for keys that very many rows share."""
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(spread, [key, "salt"], "left").drop("salt")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct `row`, so that helper columns beside it clash with none of their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """df with `pos`: its rows from 0 in the order of the columns `by` (null first, ties by where they stand in df).

    Rows are dealt by ranges and sorted there, so no task holds more than a range, whatever the keys; only the number of rows of each range
    goes through the driver."""
    own = df.withColumn("tie", F.monotonically_increasing_id())
    ranges = own.repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").drop("tie").withColumn("pos", F.monotonically_increasing_id())
    ranges = written(ranges, "ranges")  # the upper bits of pos are the number of the range
    sizes = ranges.groupBy(F.shiftright("pos", 33).alias("range")).agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r.range, total))
        total += r.n
    offsets = df.sparkSession.createDataFrame(before, "range long, before long")
    inside = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return ranges.withColumn("range", F.shiftright("pos", 33)).join(F.broadcast(offsets), "range").withColumn("pos", F.col("before") + inside).drop("range", "before")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (null: empty) and their n + 1 offsets, without a copy where Arrow has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text, so that memory follows one document at most."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
