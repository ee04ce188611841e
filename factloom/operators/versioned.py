"""Tables that change: rows by key in buckets, changes as delta files, merged when they are read.

    create(df, path, ["project", "fingerprint"])
    change(spark, path, upserts, order=["seq"])        # later rows win; deleted= gives keys that go
    current(spark, path)
    compact(spark, path, most=8)

A change is written as one small file a touched bucket; nothing that is there is read or rewritten. A manifest, a single file, lists which files make
up the table: it is written last, under the next number, so a change is seen whole or not at all, and of two writers with one number
one fails. Readers take the last manifest. Buckets without deltas are scanned as they are; in the others a row a key is left, the one of the
last change, by one aggregation that combines before its shuffle. Compaction rewrites the buckets that have many deltas, and only those.

Keys are never null; rows of a change that share a key go by `order` (of equal ones the greatest row), and a key that is both written and deleted
in one change is deleted. The number of buckets follows the rows at creation, ROWS each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket.
ROWS = 2_000_000


@dataclass(frozen=True)
class Manifest:
    """number, keys, buckets, schema (of the rows), and files: (bucket, version, folder) with version 0 for what a compaction or creation wrote."""

    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: str
    files: tuple[tuple[int, int, str], ...]


def latest(spark: SparkSession, path: str) -> Manifest:
    rows = spark.read.parquet(f"{path}/manifests")
    last = rows.where(F.col("n") == rows.agg(F.max("n")).first()[0]).collect()  # a row a file of the table
    head = last[0]
    return Manifest(head.n, tuple(head.keys), head.buckets, head.schema, tuple(sorted((r.bucket, r.version, r.folder) for r in last if r.folder is not None)))


def _commit(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    rows = [(list(m.keys), m.buckets, m.schema, *f) for f in m.files] or [(list(m.keys), m.buckets, m.schema, None, None, None)]
    schema = "keys array<string>, buckets int, schema string, bucket int, version int, folder string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/n={m.number}")
    return m


def _bucket(keys: list[str] | tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int) -> tuple[str, list[int]]:
    """The folder and the buckets that have rows."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    try:
        found = df.sparkSession.read.parquet(folder).select("_bucket").distinct().collect()  # from the names of folders
    except AnalysisException:  # nothing was written
        found = []
    return folder, sorted(r[0] for r in found)


def create(df: DataFrame, path: str, keys: list[str], rows_a_bucket: int = ROWS) -> Manifest:
    """A new table of rows whose keys are unique."""
    buckets = max(1, -(-df.count() // rows_a_bucket))
    folder, found = _write(df.withColumn("_deleted", F.lit(False)), path, tuple(keys), buckets)
    return _commit(df.sparkSession, path, Manifest(0, tuple(keys), buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), tuple((b, 0, folder) for b in found)))


def change(spark: SparkSession, path: str, upserts: DataFrame | None = None, order: list[str] | None = None, deleted: DataFrame | None = None) -> Manifest:
    """Rows put in place of those with their keys, and keys that go. Reads the manifest alone."""
    m = latest(spark, path)
    names = [c.name for c in spark.createDataFrame([], m.schema).schema]
    rest, keys, parts = [c for c in names if c not in m.keys], list(m.keys), []
    if upserts is not None:
        by = F.struct(*(order or []), *rest)
        best = upserts.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("row"))
        parts.append(best.select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest], F.lit(False).alias("_deleted")))
    if deleted is not None:
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], m.schema).schema}
        gone = deleted.select(*keys).distinct()
        if parts:
            parts[0] = parts[0].join(gone, keys, "left_anti")
        parts.append(gone.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], F.lit(True).alias("_deleted")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    folder, touched = _write(rows.select(*names, "_deleted"), path, m.keys, m.buckets)
    files = (*m.files, *((b, m.number + 1, folder) for b in touched))
    return _commit(spark, path, Manifest(m.number + 1, m.keys, m.buckets, m.schema, files))


def _merged(spark: SparkSession, m: Manifest, buckets: set[int]) -> DataFrame:
    """The rows of some buckets."""
    schema = f"{m.schema}, _deleted boolean"
    names = [c.name for c in spark.createDataFrame([], m.schema).schema]
    own = [f for f in m.files if f[0] in buckets]
    with_deltas = {f[0] for f in own if f[1] > 0}
    folder = lambda f: f"{f[2]}/_bucket={f[0]}"
    parts = []
    if plain := [folder(f) for f in own if f[0] not in with_deltas]:
        parts.append(spark.read.schema(schema).parquet(*plain).where("NOT _deleted").select(*names))
    versions = sorted({f[1] for f in own if f[0] in with_deltas})
    reads = [spark.read.schema(schema).parquet(*[folder(f) for f in own if f[0] in with_deltas and f[1] == v]).withColumn("_version", F.lit(v)) for v in versions]
    if reads:
        rows = reads[0]
        for r in reads[1:]:
            rows = rows.unionByName(r)
        rest = [c for c in names if c not in m.keys]
        last = rows.groupBy(*m.keys).agg(F.max_by(F.struct("_deleted", *rest), "_version").alias("row")).where("NOT row._deleted")
        parts.append(last.select(*[F.col(c) if c in m.keys else F.col(f"row.`{c}`").alias(c) for c in names]))
    if not parts:
        return spark.createDataFrame([], m.schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current(spark: SparkSession, path: str, manifest: Manifest | None = None) -> DataFrame:
    """The table as of its last manifest, or of an earlier one."""
    m = manifest or latest(spark, path)
    return _merged(spark, m, {f[0] for f in m.files})


def compact(spark: SparkSession, path: str, most: int = 8) -> Manifest:
    """Buckets with `most` deltas or more are rewritten without them; the others stay as they are."""
    m = latest(spark, path)
    deltas: dict[int, int] = {}
    for bucket, version, _ in m.files:
        deltas[bucket] = deltas.get(bucket, 0) + (version > 0)
    full = {b for b, n in deltas.items() if n >= most}
    if not full:
        return m
    folder, found = _write(_merged(spark, m, full).withColumn("_deleted", F.lit(False)), path, m.keys, m.buckets)
    files = (*(f for f in m.files if f[0] not in full), *((b, 0, folder) for b in found))
    return _commit(spark, path, Manifest(m.number + 1, m.keys, m.buckets, m.schema, tuple(sorted(files))))
