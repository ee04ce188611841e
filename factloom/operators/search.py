"""Shortest paths from a set of sources to each sink of a set, searched from both ends.

The forward search knows of each node how far it is from the nearest source, and the least node before it on such a way; the backward search
knows of each (node, sink) the same towards the sink. Each round goes one step on the side with fewer rows to go on from, so neither end
is searched through its wide part alone. A sink is done when a node of its backward search is known forward: as both sides are complete
up to their depth, the least sum of a sink's meetings is its distance. What belongs to sinks that are done is not gone on from. Levels are written
tables of their own, so a path is read from one level a step, in one job, without a look-up on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import table

#: Levels after which the tables that new rows are compared with are made one.
TOGETHER = 16


class _Side:
    """Levels of a search: level k has the keys first known after k steps, and `via`, the least node that they were reached from."""

    def __init__(self, start: DataFrame, keys: list[str]) -> None:
        via = F.lit(None).cast(start.schema["node"].dataType)
        self.keys, self.levels = keys, [table(start.select(*keys).distinct().withColumn("via", via))]
        self.seen = [self.levels[0].select(*keys)]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def frontier(self, open_sinks: DataFrame | None) -> DataFrame:
        last = self.levels[-1]
        return last if open_sinks is None else last.join(open_sinks, "sink", "left_semi")

    def step(self, edges: DataFrame, a: str, b: str, open_sinks: DataFrame | None = None) -> None:
        rest = [k for k in self.keys if k != "node"]
        ahead = self.frontier(open_sinks).select("node", *rest).join(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "node")
        near = ahead.groupBy(F.col("next").alias("node"), *rest).agg(F.min("node").alias("via"))
        new = table(near.join(reduce(DataFrame.union, self.seen), self.keys, "left_anti").select(*self.keys, "via"))
        self.levels.append(new)
        self.seen.append(new.select(*self.keys))
        if len(self.seen) > TOGETHER:
            self.seen = [table(reduce(DataFrame.union, self.seen))]

    def last(self) -> DataFrame:
        return self.levels[-1].withColumn("far", F.lit(self.depth))

    def numbered(self) -> DataFrame:
        return reduce(DataFrame.union, [x.withColumn("far", F.lit(k)) for k, x in enumerate(self.levels)])


def meetings(edges: DataFrame, sources: DataFrame, sinks: DataFrame, most: int | None = None) -> tuple[DataFrame, _Side, _Side]:
    """sink, steps, node, forward (steps from the source to node): of each reached sink the meeting of least steps, then least node; and
    both sides. edges: src, dst; sources, sinks: node. `most` bounds the steps of a path."""
    edges = table(edges.select("src", "dst").distinct())
    ahead = _Side(sources.select("node"), ["node"])
    back = _Side(sinks.select("node", F.col("node").alias("sink")), ["node", "sink"])
    open_sinks, done = table(sinks.select(F.col("node").alias("sink")).distinct()), []
    known, near = ahead.numbered(), back.numbered()
    while True:
        # What was known before has met already, so only the level that is new on one side is compared with the other side.
        met = near.select("node", "sink", F.col("far").alias("left")).join(known.select("node", F.col("far").alias("forward")), "node").join(open_sinks, "sink", "left_semi")
        best = met.groupBy("sink").agg(F.min(F.struct((F.col("forward") + F.col("left")).alias("steps"), "node", "forward")).alias("m"))
        done.append(table(best.select("sink", "m.*")))
        if not done[-1].isEmpty():
            open_sinks = table(open_sinks.join(done[-1], "sink", "left_anti"))
        on, to_go = ahead.levels[-1].count(), back.frontier(open_sinks).count()
        if not on or not to_go or (most is not None and ahead.depth + back.depth >= most):
            return reduce(DataFrame.union, done), ahead, back
        if on <= to_go:
            ahead.step(edges, "src", "dst")
            known, near = ahead.last(), back.numbered()
        else:
            back.step(edges, "dst", "src", open_sinks)
            known, near = ahead.numbered(), back.last()


def shortest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, most: int | None = None) -> DataFrame:
    """sink, steps, path (nodes from a source to the sink): one shortest path of each sink that a source reaches."""
    found, ahead, back = meetings(edges, sources, sinks, most)
    rows = found.select("sink", "steps", F.col("node").alias("at"), F.col("forward").alias("far"), F.array("node").alias("path"), F.col("node").alias("meet"), (F.col("steps") - F.col("forward")).alias("left"))
    for k in range(ahead.depth, 0, -1):  # back to the source: those that stand k steps from it go to the node before
        level = ahead.levels[k].select(F.col("node").alias("at"), F.lit(k).alias("far"), "via")
        rows = rows.join(level, ["at", "far"], "left").select("sink", "steps", F.coalesce("via", "at").alias("at"), F.when(F.col("via").isNull(), F.col("far")).otherwise(F.col("far") - 1).alias("far"), F.when(F.col("via").isNull(), F.col("path")).otherwise(F.concat(F.array("via"), "path")).alias("path"), "meet", "left")
    rows = rows.select("sink", "steps", F.col("meet").alias("at"), "left", "path")
    for k in range(back.depth, 0, -1):  # and on to the sink
        level = back.levels[k].select(F.col("node").alias("at"), "sink", F.lit(k).alias("left"), "via")
        rows = rows.join(level, ["at", "sink", "left"], "left").select("sink", "steps", F.coalesce("via", "at").alias("at"), F.when(F.col("via").isNull(), F.col("left")).otherwise(F.col("left") - 1).alias("left"), F.when(F.col("via").isNull(), F.col("path")).otherwise(F.concat("path", F.array("via"))).alias("path"))
    return rows.select("sink", "steps", "path")
