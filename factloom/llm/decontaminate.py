"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is WINDOW consecutive words of an item (all words of a shorter item). Of the k-word grams in every run of WINDOW - k + 1
grams the one with the least hash is a fingerprint, so a shared window always shares a fingerprint at the same place. Documents and
items meet on fingerprints; each hit is compared word by word and extended to both sides, far enough to span every window around it,
and counts if the extended run is a window or longer. Hashes only find candidates: words decide. A hit carries the words that windows
around it can hold, not the text, so memory follows the text and its hits; places of an item with the same such words are one.

The items' fingerprints are broadcast only after they were counted and are at most BROADCAST_ROWS; beyond that, fingerprints meet in
a shuffled join without the texts (Spark splits a hot gram's partition), and a document's hits go back to its text together.

Defined results: a null or empty text has no words and no hits; a benchmark without words leaves all clean; repeated items count
once by item_id, and an item without an id marks words but is not listed; rows of documents are keyed by doc_id (null is a key too)
and text, so repeated rows get the same result each, and texts that share a doc_id their own; items that hold one window are all
listed; extra columns, whatever their names, are ignored by scan() and kept by decontaminate(); an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import whole_row

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 200_000
# Fixed value: what makes up words once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    plain = F.lower(text)  # the same as A-Z alone where all letters are ASCII
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(F.when(F.col(text).rlike(r"[^\x00-\x7F]"), exact).otherwise(plain), F.lit(WORD), F.lit(0))


def _slid(df: DataFrame, source: str, width: int, op: Callable[[Column, Column], Column], to: str) -> DataFrame:
    """df with `to`: op over each `width` neighbours of the array `source`, by doubling. Each step is a column of its own, used twice."""
    df, have = df.withColumn(to, F.col(source)), 1
    while have < width:
        step = min(have, width - have)
        rest = F.greatest(F.size(to) - step, F.lit(0))
        df = df.withColumn(to, F.zip_with(F.slice(to, F.lit(1), rest), F.slice(to, F.lit(step + 1), rest), op))
        have += step
    return df


def _with_fingerprints(df: DataFrame, length: int, to: str) -> DataFrame:
    """df with `to`: array<struct<length, pos, hash>> of windows of `length` words, from the hashes of the words in h."""
    k = min(GRAM, length)
    run = length - k + 1
    df = _slid(df, "h", k, lambda x, y: F.xxhash64(x, y), "_grams")
    df = _slid(df, "_grams", run, lambda x, y: F.least(x, y), "_least")
    # A gram is chosen if one of the runs that hold it has it as its least, so if it is the greatest of their leasts.
    edge = F.array_repeat(F.lit(None).cast("long"), run - 1)
    df = _slid(df.withColumn("_least", F.concat(edge, "_least", edge)), "_least", run, lambda x, y: F.greatest(x, y), "_most")
    marked = F.transform(F.zip_with("_grams", "_most", lambda x, y: F.when(x == y, x)), lambda x, i: F.when(x.isNotNull(), F.struct(F.lit(length).alias("length"), i.alias("pos"), x.alias("hash"))))
    enough = F.when(F.size("h") >= length, F.filter(marked, lambda s: s.isNotNull())).otherwise(F.array().cast("array<struct<length:int,pos:int,hash:bigint>>"))
    return df.withColumn(to, enough).drop("_grams", "_least", "_most")


def _near(words: str, place: str) -> Column:
    """struct<words, left>: the words that windows around a fingerprint can hold, and how many of them stand before it."""
    around = F.col("length") - F.least(F.col("length"), F.lit(GRAM))
    left = F.least(F.col(place), around)
    return F.struct(F.slice(words, F.col(place) - left + 1, left + F.col("length")).alias("words"), left.alias("left"))


def item_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, item (near words), length, hash; and the window lengths in use, at most WINDOW of them."""
    items = benchmark.select("item_id", _words("text").alias("item")).where(F.size("item") > 0)
    items = items.withColumn("length", F.least(F.size("item"), F.lit(WINDOW))).withColumn("h", F.transform("item", lambda x: F.xxhash64(x)))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    found = F.array().cast("array<struct<length:int,pos:int,hash:bigint>>")
    for n in lengths:
        items = _with_fingerprints(items, n, f"f{n}")
        found = F.when(F.col("length") == n, F.col(f"f{n}")).otherwise(found)
    exploded = items.select("item_id", "item", F.xxhash64("item").alias("whole"), F.explode_outer(found).alias("f"))
    placed = exploded.select("item_id", "item", "whole", F.col("f.length").alias("length"), F.col("f.pos").alias("q"), F.col("f.hash").alias("hash"))
    places = placed.groupBy("item_id", "whole", "length", "hash").agg(F.collect_set(_near("item", "q")).alias("places"))
    return places.select("item_id", F.explode_outer(_widest()).alias("item"), "length", "hash").distinct(), lengths


def _widest() -> Column:
    """Of an item's places with one fingerprint, those that no other covers. Only places at an edge of the item have fewer words than others;
    where all its words stand alike in another place, that one makes every hit of it, with a span that holds its span."""
    most = 2 * F.col("length") - F.least(F.col("length"), F.lit(GRAM))
    covers = lambda t, s: (F.size(t["words"]) > F.size(s["words"])) & (t["left"] >= s["left"]) & (F.slice(t["words"], t["left"] - s["left"] + 1, F.size(s["words"])) == s["words"])
    return F.filter("places", lambda s: (F.size(s["words"]) >= most) | ~F.exists("places", lambda t: covers(t, s)))


def _span() -> Column:
    """struct<a, b> of the run of equal words around a hit, or null if it is no window; from near (of the document), item and pos."""
    k = F.least(F.col("length"), F.lit(GRAM))
    near, item, pos = F.col("near"), F.col("item"), F.col("pos")
    equal = lambda i: F.coalesce(F.get(near["words"], near["left"] + i) == F.get(item["words"], item["left"] + i), F.lit(False))
    reach = F.sequence(F.lit(1), F.lit(WINDOW))
    within = lambda t: t <= F.col("length") - k
    run = lambda place: F.array_position(F.concat(F.transform(reach, lambda t: within(t) & equal(place(t))), F.array(F.lit(False))), False) - 1
    gram = F.forall(F.sequence(F.lit(0), F.lit(GRAM - 1)), lambda t: (t >= k) | equal(t))
    left, right = run(lambda t: -t), run(lambda t: k - 1 + t)
    a, b = pos - left, pos + k + right
    return F.when(gram & (b - a >= F.col("length")), F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))


def _met(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words (on one row of each row of docs), item_id, span (on rows of hits)."""
    items, lengths = item_fingerprints(benchmark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), _words("text").alias("w"))
    hashed = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for x in lengths:
        hashed = _with_fingerprints(hashed, x, f"f{x}")
    # The mark tells the number of words; it passes the join by a row of its own, so that texts are read and split once.
    mark = F.array(F.struct(F.lit(0).alias("length"), F.size("w").alias("pos"), F.lit(0).cast("long").alias("hash")))
    prints = F.concat(*[f"f{x}" for x in lengths], mark)
    parts = [F.col("f.length").alias("length"), F.col("f.pos").alias("pos"), F.col("f.hash").alias("hash")]
    hit = F.col("length") > 0
    near = F.when(hit, _near("w", "pos")).alias("near")
    if items.count() <= BROADCAST_ROWS:
        none = F.lit(None).cast(items.schema["item"].dataType).alias("item")
        own = items.sparkSession.range(1).select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), none, F.lit(0).alias("length"), F.lit(0).cast("long").alias("hash"))
        exploded = hashed.select("doc_id", "text_hash", "w", prints.alias("prints")).select("doc_id", "text_hash", "w", F.explode_outer("prints").alias("f"))
        met = exploded.select("doc_id", "text_hash", "w", *parts).join(F.broadcast(items.union(own)), ["length", "hash"])
        met = met.select("doc_id", "text_hash", "item_id", "item", "length", "pos", near)
    else:
        exploded = hashed.select("doc_id", "text_hash", F.explode_outer(prints).alias("f")).select("doc_id", "text_hash", *parts)
        found = exploded.where(hit).join(items, ["length", "hash"]).groupBy("doc_id", "text_hash")
        found = found.agg(F.collect_set(F.struct("item_id", "item", "length", "pos")).alias("met"))
        texts = base.dropDuplicates(["doc_id", "text_hash"])
        found = found.alias("f").join(texts.alias("b"), F.expr("f.doc_id <=> b.doc_id and f.text_hash = b.text_hash"))
        found = found.select("f.doc_id", "f.text_hash", "w", F.explode_outer("met").alias("m")).select("doc_id", "text_hash", "w", "m.*")
        met = found.select("doc_id", "text_hash", "item_id", "item", "length", "pos", near)
        met = met.unionByName(exploded.where(~hit).drop("hash"), allowMissingColumns=True)
    # explode_outer, here and above: explode would add a filter on its array, which moves down and computes the array again (inside
    # the join, or word by word inside the lambdas).
    span = F.when(hit, _span())
    met = met.select("doc_id", "text_hash", "item_id", F.when(~hit, F.col("pos")).alias("n_words"), F.explode_outer(F.array(span)).alias("span"))
    return met.where(F.col("span").isNotNull() | F.col("n_words").isNotNull())


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, copies, n_words, spans (hit words, may overlap), items: a row for each distinct row of docs."""
    item = F.when(F.col("span").isNotNull(), F.col("item_id").cast("string"))
    return _met(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set(item).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    longer = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("n"))
    covered = F.aggregate(F.sort_array("spans"), start, longer)["n"]
    found = hits(docs, benchmark).withColumn("n_hit", covered)
    rows = found.withColumn("copy", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without hits, with all their columns."""
    found = hits(docs, benchmark).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    return keyed.join(found, F.expr("own_id <=> hit_id and own_hash = hit_hash"), "left_anti").select("row.*")


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[p + 1:p + n], 'string_agg', ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM items)),
doc_windows AS (
  SELECT doc_id, n, p, list_aggregate(w[p + 1:p + n], 'string_agg', ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, p, m.n FROM doc_windows m JOIN item_windows i ON m.t = i.t AND m.n = i.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
