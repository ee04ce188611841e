"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a target of words: its weight's share of a multiple of all words, at most `cap` times its own words; what a stopped
source leaves is shared again by weight until no source is above its cap. A source's documents get Efraimidis-Spirakis keys
-ln(u) / weight, with u from the md5 of doc_id (of the text where it is null), so reruns agree; the weight is the document's quality.
Complete epochs come first;
the rest of the target goes to the documents with the smallest keys, by a prefix sum over the sorted keys, and the document at the
edge gives the words that are left.

A hot source is never sorted as a whole: keys fall into ranges of equal probability, one for each RANGE_DOCS documents of the table; a
sum per range gives what stands before each range, and windows sort one range of one source. Sizes are counted once, in a table.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a source without words has
target 0; rows without doc_id have their texts' keys; rows that repeat are documents of their own (equal rows share a key, and the
prefix sum runs over them in turn); an empty table gives no rows; other columns, whatever their names, are left out of the counts and
kept by mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import whole_row, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents of the table for each range of keys; a range of one source is a window of its own.
RANGE_DOCS = 250
#: Weight of a document by its quality label: 0, 1, none.
LOW, HIGH, NONE = 0.5, 1.5, 1.0


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: between LOW and HIGH by the mean of its labels."""
    mean = F.coalesce(F.avg("quality"), F.lit((NONE - LOW) / (HIGH - LOW)))
    return labels.groupBy("doc_id").agg((LOW + (HIGH - LOW) * mean).alias("weight"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target from rows with source and size. One row a source: the windows here run over that summary."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    table = F.array(*[F.lit(w) for w in weights])
    out = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ordered) - 1)
        .withColumn("w", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("stop", F.col("source_size") * cap)
        .withColumn("ratio", F.col("stop") / F.col("w"))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.col("stopped")) / F.col("open_w"))
        .withColumn("at", F.row_number().over(by_ratio))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(everything)
    level = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(everything)
    target = F.least(F.col("stop").cast("double"), F.coalesce(level * F.col("w"), F.col("stop").cast("double")))
    return out.withColumn("first", first).withColumn("target", F.round(target, 6)).select("source", "source_size", "target")


def mix_counts(docs: DataFrame, quality: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken; keep: columns of docs to carry along."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(2**52))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("doc_id", "source", size.alias("size"), u.alias("u"), *keep), "sizes")
    n_ranges = max(1, -(-sizes.count() // RANGE_DOCS))
    keyed, weight = sizes, F.lit(NONE)
    if quality is not None:
        keyed, weight = keyed.join(quality, "doc_id", "left"), F.coalesce("weight", F.lit(NONE))
    keyed = keyed.withColumn("key", -F.ln("u") / weight).withColumn("range", F.least(F.floor(n_ranges * (1 - F.exp(-F.col("key")))), F.lit(n_ranges - 1)).cast("int"))
    targets = source_targets(sizes)
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    t, r = targets.alias("t"), ranges.alias("r")
    plan = r.join(t, F.expr("r.source <=> t.source")).select("r.source", "range", "before", "source_size", "target")
    k, p = keyed.alias("k"), plan.alias("p")
    joined = k.join(p, F.expr("k.source <=> p.source and k.range = p.range")).select("k.*", "before", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.greatest(F.round("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0))
    prefix = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.least(rest - prefix, F.col("size")), F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", *keep)
    )


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each epoch, and one with the first words where a part is taken."""
    rows = docs.select(whole_row(docs), F.xxhash64("text").alias("mark"))
    same = Window.partitionBy("row.doc_id", "row.source", "mark").orderBy(F.lit(0))
    rows = rows.withColumn("copy", F.row_number().over(same))
    counts = mix_counts(rows.select("row.doc_id", "row.source", "row.text", "mark", "copy"), quality, ("mark", "copy"))
    r, c = rows.alias("r"), counts.alias("c")
    joined = r.join(c, F.expr("r.row.doc_id <=> c.doc_id and r.row.source <=> c.source and r.mark = c.mark and r.copy = c.copy")).select("r.row", "c.size", "c.epochs", "c.taken")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    repeats = F.array_repeat(F.lit(False), F.col("epochs").cast("int"))
    times = F.concat(repeats, F.when(part > 0, F.array(part < F.col("size"))).otherwise(F.array().cast("array<boolean>")))
    times = joined.where(F.col("taken") > 0).select("row", part.cast("int").alias("words"), F.explode_outer(times).alias("cut"))
    blank = F.when(F.length(F.regexp_extract("row.text", r"^[\x20\x09-\x0D]*", 0)) > 0, 1).otherwise(0)
    first = F.array_join(F.slice(F.split("row.text", r"[\x20\x09-\x0D]+"), F.lit(1), F.col("words") + blank), " ")
    text = F.when(F.col("cut"), first).otherwise(F.col("row.text"))
    return times.select(*[text.alias("text") if x == "text" else F.col(f"row.`{x}`") for x in docs.columns])


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
weights AS (
  SELECT doc_id, 0.5 + coalesce(avg(quality), 0.5) AS weight FROM labels GROUP BY doc_id),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sizes GROUP BY source),
steps AS (
  SELECT *, row_number() OVER r AS pos, 2 * source_size / w AS ratio,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src WINDOW r AS (ORDER BY 2 * source_size / w, rank)),
chosen AS (SELECT level FROM steps WHERE level <= ratio ORDER BY pos LIMIT 1),
targets AS (
  SELECT source, source_size, round(least(2 * source_size, coalesce((SELECT level FROM chosen) * w, 2 * source_size))::DOUBLE, 6) AS target FROM steps),
keyed AS (
  SELECT s.*, -ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, s.text, '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0) AS key
  FROM sizes s LEFT JOIN weights USING (doc_id)),
running AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(least(greatest(round(target)::BIGINT - epochs * source_size, 0) - prefix, size), 0))::BIGINT AS taken
FROM running
"""
