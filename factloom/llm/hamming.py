"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is above 0. A code is cut into segments of BITS bits. The index is one
table over all codes with a row for each segment, keyed by the segment's number and its upper bits: as many as leave about BUCKET codes a
key. A query looks up, in each segment, the keys whose upper bits differ from its own in at most `radius` places, by an equality join;
the lower bits decide within the join. After radius r every code within m (r + 1) - 1 of the query has been found, m being the number of
segments: two codes that are nearer differ in at most r bits of some segment.

Radii grow until the kth verified distance is provably covered. All queries start with FIRST_RADIUS; a query that has k results knows
the radius that covers its kth distance and goes there in one step, looking for no more than that distance; one with fewer goes on by
one. A code is found once a query: by the first of the segments in which it is nearest, at the radius of that one, so rounds need not be
compared with each other. Ties at the kth distance are complete. A round's results are written, so its lineage ends there.

What is shuffled follows the rows: a row a segment of each code, and for each query a row a segment and near key. Equal codes are one
entry with their k smallest ids, so no copies pile up; a key that many codes share is a join partition that Spark can split. The query set
is rows whose id is divisible by EVERY.

Defined results: a query finds itself too, at distance 0; order is distance, then vec_id; with fewer than k rows all are returned; a null
vector or id is left out; a shorter vector counts as padded with zeros, and NaN as no set bit; a repeated row of an id is found once for
each, and of different rows of one query id the one with the least code asks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import written

K, EVERY, BITS = 10, 50, 16
#: Codes for each key of a segment.
BUCKET = 1024
FIRST_RADIUS = 2
#: Rows of the index for each task of a round.
TASK_ROWS = 1 << 14


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code: words of 64 bits."""
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = -(-size // 64) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            n = np.diff(np.asarray(column.offsets)).astype(np.int64)
            values = np.nan_to_num(np.asarray(column.flatten().fill_null(0.0)), nan=0.0)
            bits = np.zeros((len(n), width), bool)
            bits[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = values > 0
            words = np.packbits(bits, axis=1).view("<i8").ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, width // 64, dtype=np.int32), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), lists], ["vec_id", "code"])

    return rows.mapInArrow(run, "vec_id long, code array<long>")


def _segment(code: str, s: int) -> Column:
    return F.shiftrightunsigned(F.col(code)[s * BITS // 64], s * BITS % 64).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _segments(rows: DataFrame, m: int, low: int) -> DataFrame:
    """rows with a row for each segment: its number, its upper bits and its `low` lower ones."""
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), _segment("code", s).alias("value")) for s in range(m)])
    spread = rows.withColumn("part", F.explode_outer(parts)).select(*rows.columns, "part.*")
    return spread.select(*rows.columns, "segment", F.shiftright("value", low).alias("upper"), F.col("value").bitwiseAND(F.lit((1 << low) - 1)).alias("lower"))


def _round(asks: DataFrame, index: DataFrame, masks: DataFrame, m: int, low: int, tasks: int) -> DataFrame:
    """query_id, distance, ids of the codes that asks (query_id, code, from, to, within) find at radii from...to and no further than within."""
    probes = _segments(asks.withColumn("flips", F.explode_outer(F.sequence(F.lit(0), F.least("to", F.lit(BITS - low))))), m, low)
    probes = probes.join(F.broadcast(masks), "flips").select(
        "query_id", F.col("code").alias("asked"), "flips", "from", "to", "within", "segment", F.col("upper").bitwiseXOR(F.col("mask")).alias("upper"), F.col("lower").alias("asked_lower"),
    )
    # Few rows meet many, so what counts is the number of tasks, not the bytes that they read.
    p, i = (x.repartition(tasks, "segment", "upper").alias(name) for x, name in ((probes, "p"), (index, "i")))
    own = F.col("flips") + F.bit_count(F.col("asked_lower").bitwiseXOR(F.col("lower")))
    words = [F.col("asked")[w].bitwiseXOR(F.col("code")[w]) for w in range(m * BITS // 64)]
    distance = sum((F.bit_count(w) for w in words), F.lit(0))
    met = p.join(i, F.expr("p.segment = i.segment and p.upper = i.upper") & (own >= F.col("from")) & (own <= F.col("to")) & (distance <= F.col("within")))
    # Found by the first of the segments in which it is nearest: those before are farther, those after no nearer.
    for s in range(m):
        shift = s * BITS % 64
        mask = ((1 << BITS) - 1) << shift
        far = F.bit_count(words[s * BITS // 64].bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
        met = met.where(far >= own + F.when(F.lit(s) < F.col("p.segment"), 1).otherwise(0))
    return met.select("query_id", distance.alias("distance"), "ids")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, distance."""
    rows = written(codes(vectors), "codes")
    spark = rows.sparkSession
    total, width = rows.agg(F.count("*"), F.max(F.size("code"))).first()
    m = (width or 1) * 64 // BITS
    key_bits = min(BITS, max(1, (total // BUCKET).bit_length()))
    low = BITS - key_bits
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("nth") <= k)
    entries = ranked.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = written(_segments(entries, m, low), "index")
    masks = spark.range(1 << key_bits).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("flips"))
    asks = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("code").alias("code"))
    asks = asks.select("query_id", "code", F.lit(0).alias("from"), F.lit(FIRST_RADIUS).alias("to"), F.lit(m * BITS).alias("within"))
    tasks = max(8, total * m // TASK_ROWS)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, distance int")
    while True:
        asks = written(asks, "asks")
        if not asks.limit(1).count():
            break
        found = _round(asks, index, masks, m, low, tasks).select("query_id", F.explode_outer("ids").alias("vec_id"), "distance")
        best = best.union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = written(best.select("query_id", "vec_id", "distance"), "best")
        have = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        known = asks.join(have, "query_id", "left")
        enough = F.coalesce(F.col("n") >= k, F.lit(False))
        covers = F.ceil((F.col("kth") + 1) / F.lit(m)).cast("int") - 1  # the least radius that covers the kth distance
        left = known.where((F.col("to") < BITS) & ~(enough & (covers <= F.col("to"))))
        asks = left.select("query_id", "code", (F.col("to") + 1).alias("from"), F.when(enough, covers).otherwise(F.col("to") + 1).alias("to"), F.when(enough, F.col("kth")).otherwise(F.col("within")).alias("within"))
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))


OP10_SQL = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum([CASE WHEN (q.e[i] > 0) <> (v.e[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, len(q.e) + 1)])::BIGINT AS distance
  FROM v AS q, v WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10
"""
