"""Flow graphs: reachability, shortest paths, taint, connascence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import cut

#: Strengths, weakest first. Fixed values, as are the bands in strength().
STRENGTHS = ("VeryLow", "Low", "Medium", "High", "VeryHigh")


#: Steps of a search after which its tables are made one.
TOGETHER = 16


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth, parent (the least node a step before; null at the start): nodes reachable from the start nodes and the least number
    of steps. One join a step, until nothing is new. A step writes what is new alone; tables are made one every TOGETHER steps."""
    frontier = cut(start.select("node").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast(start.schema["node"].dataType)))
    steps, depth = [frontier], 0
    while True:
        depth += 1
        seen = reduce(DataFrame.union, steps)
        near = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(frontier["node"]).alias("parent"))
        frontier = cut(near.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            return seen
        steps = [cut(seen.union(frontier))] if depth % TOGETHER == 0 else [*steps, frontier]


def _known(edges: DataFrame, node) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).where(F.col("node") == node).distinct()


def reachable(edges: DataFrame, node) -> DataFrame:
    """Nodes reachable from a node, itself included, and their depth; empty for an unknown one."""
    return distances(edges, _known(edges, node)).select("node", "depth")


def shortest_path(edges: DataFrame, a, b) -> DataFrame:
    """step, node of one shortest path; of several the one with the smallest nodes from the end back. Empty without a path."""
    spark = edges.sparkSession
    far = cut(distances(edges, _known(edges, a)))
    steps, node = [], b
    while node is not None and (row := far.where(F.col("node") == node).first()) is not None:  # a look-up a step, no join
        steps.append((row.depth, node))
        node = row.parent
    return spark.createDataFrame(sorted(steps), "step int, node long")


def flow_edges(flows: DataFrame) -> DataFrame:
    """Sources to sanitizers, and sanitizers (or sources, where there are none) to sinks, within each flow."""
    pick = lambda kind, name: flows.where(F.col("fact_type") == kind).select("flow_id", F.col("node").alias(name))
    source, clean, sink = pick("TaintSource", "src"), pick("Sanitization", "mid"), pick("TaintSink", "dst")
    direct = source.join(sink, "flow_id").join(clean.select("flow_id").distinct(), "flow_id", "left_anti").select("src", "dst")
    return source.join(clean, "flow_id").select("src", F.col("mid").alias("dst")).union(clean.join(sink, "flow_id").select(F.col("mid").alias("src"), "dst")).union(direct)


def tainted(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("fact_type") == "TaintSource").select("flow_id").distinct()


def flows_to_sink(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("fact_type") == "TaintSink").select("flow_id", "func").distinct().join(tainted(flows), "flow_id", "left_semi")


def sanitized(flows: DataFrame) -> DataFrame:
    return flows.where((F.col("fact_type") == "Sanitization") & F.col("effective")).select("flow_id").distinct().join(tainted(flows), "flow_id", "left_semi")


def unsanitized(flows: DataFrame) -> DataFrame:
    """flow_id, func, source: sinks that taint reaches and nothing cleans, with the first source of the flow."""
    first = flows.where(F.col("fact_type") == "TaintSource").groupBy("flow_id").agg(F.min("node").alias("source"))
    return flows_to_sink(flows).join(sanitized(flows), "flow_id", "left_anti").join(first, "flow_id")


def policy_matches(flows: DataFrame, policy: dict[str, list[str]]) -> DataFrame:
    """flow_id, node, role, pattern: nodes that a policy's patterns name as part of their own text; one pass, patterns are literals."""
    parts = {"source": ("TaintSource", ["var"]), "sink": ("TaintSink", ["func", "category"]), "sanitizer": ("Sanitization", ["method"])}
    hits = []
    for role, patterns in policy.items():
        kind, columns = parts[role]
        for p in patterns:
            met = F.lit(False)
            for c in columns:
                met = met | F.col(c).contains(p)
            hits.append(F.when((F.col("fact_type") == kind) & met, F.struct(F.lit(role).alias("role"), F.lit(p).alias("pattern"))))
    return flows.select("flow_id", "node", F.explode(F.array_compact(F.array(*hits))).alias("m")).select("flow_id", "node", "m.role", "m.pattern")


def connascence(entities: DataFrame, column: str, kind: str) -> DataFrame:
    """kind, shared, entities, frequency of values that two entities or more share."""
    groups = entities.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("shared")).agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("frequency"))
    return groups.where(F.col("entities") > 1).select(F.lit(kind).alias("kind"), "shared", "entities", "frequency")


def strength(kind: Column, entities: Column, frequency: Column) -> Column:
    """1 (very low) to 5 (very high): by entities, raised for kinds that are hard to see and lowered for easy ones, raised by frequent use."""
    base = F.when(entities <= 1, 1).when(entities <= 3, 2).when(entities <= 6, 3).when(entities <= 10, 4).otherwise(5)
    by_kind = F.when(kind.isin("Algorithm", "Meaning") & base.isin(2, 3), base + 1).when(kind.isin("Name", "Position"), F.least(base, F.lit(4))).otherwise(base)
    return F.when((frequency > 10) & by_kind.between(2, 4), by_kind + 1).otherwise(by_kind)


#: Parameters of one type from which a function counts as bound to their order. Fixed value.
LEAST_PARAMETERS = 3


def signatures(members: DataFrame) -> DataFrame:
    """entity, signature (the types of its members in their order) of entities with LEAST_PARAMETERS members or more. members: entity, place, type."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "type")))
    rows = members.groupBy("entity").agg(ordered.alias("m")).where(F.size("m") >= LEAST_PARAMETERS)
    return rows.select("entity", F.array_join(F.transform("m", lambda x: x["type"]), ",").alias("signature"))


def all_connascence(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Connascence of the five kinds. entities: entity, var, type, literal; members: entity, place, type, step (what is done there)."""
    parts = [connascence(entities, "var", "Name"), connascence(entities, "type", "Type"), connascence(entities, "literal", "Meaning")]
    parts.append(connascence(signatures(members), "signature", "Position"))
    parts.append(connascence(signatures(members.select("entity", "place", F.col("step").alias("type"))), "signature", "Algorithm"))
    return reduce(DataFrame.union, parts)
