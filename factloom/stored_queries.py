"""Registered queries of kept structures: one scan for many patterns, rows by their number, and a trend that a stream maintains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import folders, indexed, intervals, phrases
from factloom.queries import Views, query
from factloom.streaming import trend

# Patterns of each three tokens of the benchmark's items: the outer two around any token, and the inner one between two that are alike.


def _patterns(v: Views) -> DataFrame:
    three = v.table("benchmark").select(F.regexp_extract_all("text", F.lit(phrases.TOKEN), F.lit(0)).alias("w")).where(F.size("w") > 2)
    three = three.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("w"))
    first, second, third = (F.col("w")[k] for k in range(3))
    around = F.concat_ws(" ", first, F.lit("$A"), third)
    between = F.concat(F.lit("$A "), second, F.lit(" $A"))
    return three.select(F.explode(F.array(around, between)).alias("pattern")).distinct().select(F.col("pattern").alias("rule"), F.lit(None).cast("string").alias("language"), "pattern")


def _places(v: Views) -> DataFrame:
    return phrases.places(v.table("documents"), _patterns(v))


_TOKEN_SQL = phrases.TOKEN.replace("'", "''")
_PLACES = rf"""WITH e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM (SELECT doc_id, regexp_extract_all(text, '\n|{_TOKEN_SQL}') AS l FROM documents)),
k AS (SELECT doc_id, i, t, 1 + count(*) FILTER (t = chr(10)) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM e),
s AS (SELECT doc_id, t, line, row_number() OVER w - 1 AS start, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM k WHERE t <> chr(10) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT item_id, regexp_extract_all(text, '{_TOKEN_SQL}') AS w FROM benchmark),
p AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b),
around AS (SELECT DISTINCT w[i] AS a, w[i + 2] AS c FROM p),
between_two AS (SELECT DISTINCT w[i + 1] AS m FROM p)
SELECT doc_id, a || ' $A ' || c AS rule, line, start, t2 AS bound FROM s JOIN around ON t = a AND t3 = c
UNION ALL SELECT doc_id, '$A ' || m || ' $A' AS rule, line, start, t AS bound FROM s JOIN between_two ON t2 = m WHERE t = t3"""
query("src_25_many_patterns", lambda v: _places(v).select("doc_id", "rule", "line", "start", F.col("bound")["A"].alias("bound")), _PLACES)
query(
    "rem_19_pattern_counts",
    lambda v: _places(v).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.min("line").alias("first_line")),
    f"SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS documents, min(line) AS first_line FROM ({_PLACES}) GROUP BY 1",
)


def _kind(pattern: Column) -> Column:
    return F.when(pattern.startswith("$A"), "vulnerability").otherwise("layout")


query(
    "src_26_pattern_messages",
    lambda v: phrases.facts(_places(v), _patterns(v).select("rule", _kind(F.col("rule")).alias("category"), F.lit("error").alias("level"), F.lit("found $A here").alias("message")))
    .groupBy("fact_type", "severity", "message").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN rule LIKE '$A %' THEN 'Vulnerability' ELSE 'CodeSmell' END AS fact_type, 'Critical' AS severity, 'found ' || bound || ' here' AS message, count(*) AS n "
    f"FROM ({_PLACES}) GROUP BY ALL",
)


# Facts by their number in the order of their ids.
def _indexed(v: Views) -> str:
    facts = v.facts
    return v.stored("indexed-facts", lambda path: indexed.write(facts, path, ["fact_id"]))


query(
    "src_23_stored_fact_at_index",
    lambda v: indexed.at(v.spark, _indexed(v), v.facts.schema, 1041).select("fact_id", "fact_type", "file"),
    "SELECT fact_id, fact_type, file FROM facts ORDER BY fact_id LIMIT 1 OFFSET 1041",
    "facts",
)
query(
    "src_23_stored_page",
    lambda v: indexed.page(v.spark, _indexed(v), v.facts.schema, 2000, 500).select("number", "fact_id", "severity"),
    "SELECT row_number() OVER (ORDER BY fact_id) - 1 AS number, fact_id, severity FROM facts ORDER BY fact_id LIMIT 500 OFFSET 2000",
    "facts",
)
query("src_23_stored_count", lambda v: indexed.count(v.spark, _indexed(v)).select("n"), "SELECT count(*) AS n FROM facts", "facts")

# The trend of all events: a stream of several batches in no order of time, folded once and started again.
_KEYS = ["event_type"]


def _kept(v: Views) -> DataFrame:
    events = v.table("events")

    def run(path: str) -> None:
        events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{path}/in")
        stream = v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        trend.kept(stream, f"{path}/trend", f"{path}/at", _KEYS).awaitTermination()
        trend.fold(v.spark, f"{path}/trend", events.schema, _KEYS, 1)
        trend.kept(stream, f"{path}/trend", f"{path}/at", _KEYS).awaitTermination()

    return trend.trend(v.spark, f"{v.stored('kept-trend', run)}/trend", events.schema, _KEYS)


query("str_02_kept_trend", _kept, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")


# Two versions of the documents as files in folders: some changed, some new, some gone.
def _file_versions(v: Views) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), (F.col("doc_id") % 50).cast("string"), F.col("doc_id").cast("string"))
    docs = v.table("documents").select(path.alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("doc_id % 101 <> 2").select("path", F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 89 <> 1").select("path", F.sha2(F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    one = v.stored("old-tree", lambda path: folders.write(old, path))
    other = v.stored("new-tree", lambda path: folders.write(new, path))
    return folders.compare(v.spark, one, other).changes


_IN_FOLDERS = """SELECT * FROM (SELECT coalesce(source, 'none') || '/' || (doc_id % 50) || '/' || doc_id AS path,
  CASE WHEN doc_id % 101 = 2 AND doc_id % 89 <> 1 THEN 'Added' WHEN doc_id % 89 = 1 AND doc_id % 101 <> 2 THEN 'Deleted' WHEN doc_id % 101 <> 2 AND doc_id % 89 <> 1 AND doc_id % 97 = 0 THEN 'Modified' END AS change
  FROM documents) WHERE change IS NOT NULL"""
query("set_06_changes_by_folders", _file_versions, _IN_FOLDERS)
query(
    "src_37_changed_folders",
    lambda v: _file_versions(v).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "change").agg(F.count("*").alias("n")),
    f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, change, count(*) AS n FROM ({_IN_FOLDERS}) GROUP BY ALL",
)


# Ranges of one line to a million.
def _long_overlaps(v: Views) -> DataFrame:
    reach = v.facts.withColumn("end_line", F.expr("start_line + cast(power(10, start_line % 7) as bigint)"))
    side = lambda kind: reach.where(F.col("fact_type") == kind).select("file", "start_line", "end_line", "fact_id")
    met = intervals.overlaps(side("Vulnerability"), side("UncoveredLine"))
    return met.select(F.col("left.file").alias("file"), F.col("left.fact_id").alias("left_fact_id"), F.col("right.fact_id").alias("right_fact_id"))


query(
    "join_04_long_overlaps",
    _long_overlaps,
    "SELECT a.file, a.fact_id AS left_fact_id, b.fact_id AS right_fact_id FROM facts a JOIN facts b ON a.file = b.file AND a.start_line <= b.start_line + power(10, b.start_line % 7)::BIGINT AND "
    "b.start_line <= a.start_line + power(10, a.start_line % 7)::BIGINT WHERE a.fact_type = 'Vulnerability' AND b.fact_type = 'UncoveredLine'",
    "facts",
)
