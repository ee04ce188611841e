"""A Merkle manifest of a table: a tree over the rows of each part (a language), a tree over the parts, and proofs of single rows.

Rows are numbered within their parts by ranges of the order, without a window over a part. Trees are built STEPS levels at a time: GROUP
** STEPS consecutive nodes meet in one row, which becomes their subtree, so a round shrinks the table by that factor and no task holds more
than such a bundle, however large a part is. All nodes are kept in tables (part, level, index, digest).

A proof is looked up by coordinates: from the index of a leaf and the size of its part each leaf makes the coordinates of the siblings that
it needs in its bundle, which are joined with the table of nodes, put in order and folded. What lies above a bundle is the proof of its
top, found the same way and shared by its leaves, so a node near the root is joined with bundles, not with all leaves.

Defined results: a null value counts as null, an empty text as an empty value; leaves of one part go by doc_id (null first), then by
digest, so repeated rows are leaves side by side that differ in nothing but their proofs; rows without a part are a part, the first; a
single leaf is its part's subroot, a single subroot the root, and a proof without siblings is empty; a text is hashed whole, whatever its
length; columns other than those named are ignored, whatever their names; an empty table has no leaves and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import numbered, written

GROUP, STEPS = 2, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(values: list[Column]) -> Column:
    """Digest of a row: of each value its UTF-8 length, a colon and itself, or - where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _power(group: int, exponent: Column) -> Column:
    """group ** exponent, for exponents from 0 to STEPS."""
    return F.element_at(F.array(*[F.lit(group**e).cast("long") for e in range(STEPS + 1)]), exponent.cast("int") + 1)


def _ceil_div(n: Column, by: Column) -> Column:
    return F.call_function("div", n + by - 1, by)


def _height(n: Column, group: int) -> Column:
    """Levels, STEPS at most, that n nodes climb until one is left."""
    return sum((F.when(n > group**e, 1).otherwise(0) for e in range(STEPS)), F.lit(0))


def _above(below: Column, group: int) -> Column:
    """The digests over every `group` consecutive ones."""
    starts = F.sequence(F.lit(0), _ceil_div(F.size(below).cast("long"), F.lit(group)).cast("int") - 1)
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(below, i * group + 1, F.lit(group)), "").cast("binary"), 256))


def _placed(level: int, group: int) -> Column:
    """array<struct<level, idx, digest>> of a bundle's level, empty where its tree is lower."""
    first = F.col("bundle") * group ** (STEPS - level)
    out = F.transform(f"l{level}", lambda x, j: F.struct(F.lit(level).alias("level"), (first + j).alias("idx"), F.unhex(x).alias("digest")))
    return F.coalesce(out, F.array().cast("array<struct<level:int,idx:bigint,digest:binary>>"))


def _round(nodes: DataFrame, group: int) -> DataFrame:
    """part, n, level, idx, digest: the nodes (part, n of the part, idx, digest) as level 0, and up to STEPS levels above them."""
    bundle = F.call_function("div", F.col("idx"), F.lit(group**STEPS).cast("long")).alias("bundle")
    rows = nodes.groupBy("part", "n", bundle).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("own"))
    rows = rows.select("part", "n", "bundle", F.transform("own", lambda x: _hex(x["digest"])).alias("l0"))
    for level in range(1, STEPS + 1):
        rows = rows.withColumn(f"l{level}", F.when(_height(F.col("n"), group) >= level, _above(F.col(f"l{level - 1}"), group)))
    found = [_placed(level, group) for level in range(STEPS + 1)]
    return rows.select("part", "n", F.explode(F.concat(*found)).alias("x")).select("part", "n", "x.*")


def _climb(leaves: DataFrame, largest: int, group: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes, a round each, and the tops (part, n, idx, digest) of trees over leaves (part, n, idx, digest)."""
    rounds, tops = [], leaves.select("part", "n", "idx", "digest")
    while largest > 1:
        rounds.append(written(_round(tops, group), "nodes"))
        high = _height(F.col("n"), group)
        tops = rounds[-1].where(F.col("level") == high).select("part", _ceil_div(F.col("n"), _power(group, high)).alias("n"), "idx", "digest")
        largest = -(-largest // group**STEPS)
    return rounds, tops


def coordinates(group: int) -> Column:
    """array<struct<level, sib>>: where the siblings stand that a node (n, idx) needs within its bundle."""
    n, idx = F.col("n"), F.col("idx")
    at = lambda level: F.call_function("div", idx, _power(group, level))

    def of(level: Column) -> Column:
        first = F.call_function("div", at(level), F.lit(group)) * group
        run = F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda j: F.struct(level.alias("level"), (first + j).alias("sib")))
        return F.filter(run, lambda s: (s["sib"] != at(level)) & (s["sib"] < _ceil_div(n, _power(group, level))))

    return F.flatten(F.transform(F.sequence(F.lit(0), _height(n, group) - 1), of))


def _paths(rows: DataFrame, nodes: DataFrame, above: DataFrame, group: int) -> DataFrame:
    """rows (part, n, idx, more) with `path` (of each level to the root, the digests before and after) and the columns that `above` has besides.

    above: part, idx, path of the bundles' tops and more."""
    more = [c for c in rows.columns if c not in ("part", "n", "idx")]
    kept, place = F.struct(F.lit(1).alias("here"), *more), [F.col("part"), F.col("n"), F.col("idx")]
    wanted = rows.where(F.col("n") > 1).select(*place, F.explode(coordinates(group)).alias("s")).select(*place, "s.level", "s.sib")
    table = nodes.select("part", "level", F.col("idx").alias("sib"), "digest")
    found = wanted.join(table, ["part", "level", "sib"]).select(*place, F.struct("level", "sib", "digest").alias("s"), F.lit(None).cast(rows.select(kept.alias("kept")).schema["kept"].dataType).alias("kept"))
    alone = F.lit(None).cast("struct<level:int,sib:bigint,digest:binary>").alias("s")
    met = found.unionByName(rows.select(*place, alone, kept.alias("kept"))).groupBy("part", "n", "idx").agg(F.sort_array(F.collect_list("s")).alias("s"), F.first("kept", ignorenulls=True).alias("kept"))

    def step(level: Column) -> Column:
        own = F.call_function("div", F.col("idx"), _power(group, level))
        side = lambda keep: F.array_join(F.transform(F.filter("s", lambda x: (x["level"] == level) & keep(x["sib"], own)), lambda x: _hex(x["digest"])), "")
        return F.struct(side(lambda a, b: a < b).alias("before"), side(lambda a, b: a > b).alias("after"))

    high = _height(F.col("n"), group)
    low = F.when(high > 0, F.transform(F.sequence(F.lit(0), high - 1), step)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
    met = met.select("part", "idx", *[F.col(f"kept.`{c}`") for c in more], low.alias("low"), F.call_function("div", F.col("idx"), _power(group, high)).alias("top"))
    up = above.select(F.col("part").alias("up_part"), F.col("idx").alias("up_idx"), F.col("path").alias("up"), *[c for c in above.columns if c not in ("part", "idx", "path")])
    joined = met.join(up, (F.col("part") == F.col("up_part")) & (F.col("top") == F.col("up_idx")))
    return joined.withColumn("path", F.concat("low", "up")).drop("low", "up", "up_part", "up_idx", "top")


def _descend(leaves: DataFrame, rounds: list[DataFrame], above: DataFrame, group: int) -> DataFrame:
    """leaves with their paths, from the paths of the tops down."""
    for nodes in reversed(rounds[1:]):
        base = nodes.where(F.col("level") == 0).select("part", "n", "idx")
        above = written(_paths(base, nodes, above, group), "paths")
    if not rounds:  # every tree is a leaf
        up = above.withColumnRenamed("part", "up_part").withColumnRenamed("idx", "up_idx")
        return leaves.join(up, F.col("part") == F.col("up_part")).drop("n", "up_part", "up_idx")
    return _paths(leaves, rounds[0], above, group)


@dataclass
class Manifest:
    """leaves: part (number), n, idx, digest and what the rows kept; parts: the value of each part; nodes: by round, level 0 of a round
    being the tops of the one before; parts_nodes: the same of the tree over the parts; subroots: part, digest."""

    leaves: DataFrame
    parts: DataFrame
    nodes: list[DataFrame]
    parts_nodes: list[DataFrame]
    subroots: DataFrame
    root: str | None
    group: int


def build(rows: DataFrame, by: str, order: list[str], digest: str, group: int = GROUP) -> Manifest:
    """The manifest of rows that have a digest (hexadecimal), with all their columns kept beside the leaves."""
    own = rows.withColumn("digest", F.unhex(digest)).withColumnRenamed(by, "part_value")
    own = numbered(written(own, "leaves"), "part_value", *order, "digest")
    sizes = own.groupBy("part_value").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    parts = written(numbered(written(sizes, "parts"), "part_value").withColumnRenamed("pos", "part"), "parts")
    known = parts.withColumnRenamed("part_value", "known")
    leaves = own.join(known, F.col("part_value").eqNullSafe(F.col("known"))).withColumn("idx", F.col("pos") - F.col("first")).drop("known", "first", "pos", "part_value")
    leaves = written(leaves, "leaves")
    found = parts.agg(F.max("n").alias("largest"), F.count("*").alias("n")).first()
    rounds, tops = _climb(leaves, found.largest or 0, group)
    subroots = written(tops.select("part", "digest"), "subroots")
    of_parts = subroots.select(F.lit(0).cast("long").alias("part"), F.lit(found.n).cast("long").alias("n"), F.col("part").alias("idx"), "digest")
    upper, top = _climb(of_parts, found.n, group)
    first = top.select(_hex(F.col("digest")).alias("root")).first()
    return Manifest(leaves, parts, rounds, upper, subroots, first.root if first else None, group)


def proofs(m: Manifest) -> DataFrame:
    """The leaves with subroot (hexadecimal) and path: array<struct<before, after>> of hexadecimal digests, a level each up to the root."""
    spark = m.leaves.sparkSession
    start = spark.range(1).select(F.col("id").alias("part"), F.lit(0).cast("long").alias("idx"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    of_parts = m.subroots.select(F.lit(0).cast("long").alias("part"), F.lit(m.parts.count()).cast("long").alias("n"), F.col("part").alias("idx"), _hex(F.col("digest")).alias("subroot"))
    tops = _descend(of_parts, m.parts_nodes, start, m.group).select(F.col("idx").alias("part"), F.lit(0).cast("long").alias("idx"), "path", "subroot")
    return _descend(m.leaves, m.nodes, written(tops, "paths"), m.group)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def check(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: of each document, whether its row as found (every seventh by its
    id has one more in n_chars) still leads to the root of the rows as stored."""
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    of = lambda n: leaf_hash([n if c == "n_chars" else F.col(c) for c in COLUMNS])
    rows = docs.select("doc_id", F.col("lang").alias("value"), of(F.col("n_chars")).alias("leaf"), F.when(found != F.col("n_chars"), F.unhex(of(found))).alias("changed"))
    m = build(rows.select("doc_id", "value", "leaf", "changed"), "value", ["doc_id"], "leaf", group)
    proved = proofs(Manifest(m.leaves.select("part", "n", "idx", "doc_id", "digest", "changed"), m.parts, m.nodes, m.parts_nodes, m.subroots, m.root, group))
    root = F.lit(m.root).cast("string")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    out = proved.select("doc_id", _hex(F.col("digest")).alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded(_hex(F.coalesce("changed", "digest"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(n if c == "n_chars" else c) for c in COLUMNS) + ")"
#: Trees of two a group: pairs by index, level by level; a path is the list of (before, after) that the fold joins around a digest.
OP11_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {_TABLE} AS t),
ids AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc),
rows_ AS (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, {_LEAF('(n_chars + CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END)')} AS found FROM documents LEFT JOIN ids USING (doc_id)),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS part, count(*) AS n FROM rows_ GROUP BY lang),
leaves AS (SELECT doc_id, leaf, found, part, n, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM rows_ r JOIN langs l ON r.lang IS NOT DISTINCT FROM l.lang),
tree AS (
  SELECT part, n, 0 AS level, idx, leaf AS digest FROM leaves
  UNION ALL
  SELECT part, (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY part, n, level, idx // 2),
subroots AS (SELECT part, digest AS subroot, level AS height FROM tree WHERE n = 1),
upper AS (
  SELECT (SELECT count(*) FROM langs) AS n, 0 AS level, part AS idx, subroot AS digest FROM subroots
  UNION ALL
  SELECT (n + 1) // 2, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY n, level, idx // 2),
root AS (SELECT digest AS root, level AS height FROM upper WHERE n = 1),
coords AS (
  SELECT doc_id, leaf, found, part, idx, unnest(range(s.height + r.height)) AS step, s.height AS h FROM leaves JOIN subroots s USING (part), root r),
sibs AS (
  SELECT c.doc_id, c.leaf, c.found, c.part, c.idx, step, coalesce(t.digest, u.digest) AS digest,
    CASE WHEN step < h THEN (c.idx >> step) % 2 ELSE (c.part >> (step - h)) % 2 END AS side
  FROM coords c LEFT JOIN tree t ON step < h AND t.part = c.part AND t.level = step AND t.idx = xor(c.idx >> step, 1::BIGINT)
  LEFT JOIN upper u ON step >= h AND u.level = step - h AND u.idx = xor(c.part >> (step - h), 1::BIGINT)),
paths AS (
  SELECT part, idx, list({{'b': CASE WHEN side = 1 THEN coalesce(digest, '') ELSE '' END, 'a': CASE WHEN side = 0 THEN coalesce(digest, '') ELSE '' END}} ORDER BY step) AS path
  FROM sibs GROUP BY part, idx)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.b || s.a), 'string_agg', ''), '')) AS proof_sha256,
  coalesce(list_reduce(list_prepend({{'b': found, 'a': ''}}, path), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b, found) AS folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (part) LEFT JOIN paths USING (part, idx), root
"""
