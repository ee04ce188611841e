"""Overlaps of ranges of any length, without a copy of a long range for each stretch that it covers.

Each range has one home: the smallest interval of a binary tree over the lines (2 ** level of them, aligned) that holds it. Homes of ranges that
overlap lie within each other, so a pair meets either where the left range's home is the right one's home or around it, or where the right
one's is around the left one's: two equality joins that share no pair. A range is copied once a level that the other side uses, about 20
times for files of a million lines, whatever its length. The levels in use, at most 64 numbers a side, are all that the driver sees.

A short range across a coarse border has a large home and meets what lies within; each border has only as many such ranges as
overlap there.

Defined results: both ends belong to a range; a null group or end overlaps nothing; a range whose end is before its start overlaps those
that hold it whole, as the comparison of ends says; repeated rows give a pair each; lines may be negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFT = 1 << 62  # makes lines positive, so that the two ends differ in low bits alone


def _homed(df: DataFrame, side: str, group: str, start: str, end: str) -> DataFrame:
    low, high = (f(F.col(start), F.col(end)).cast("long") + F.lit(_SHIFT) for f in (F.least, F.greatest))
    known = df.where(F.col(group).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    apart = low.bitwiseXOR(high)
    level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
    return known.select(F.struct(*df.columns).alias(side), F.col(group).alias("_group"), F.col(start).alias(f"_{side}_start"), F.col(end).alias(f"_{side}_end"), low.alias("_low"), level.alias("_level"))


def _node(level: str) -> Column:
    return F.expr(f"shiftright(_low, {level})")


def overlaps(left: DataFrame, right: DataFrame, group: str = "file", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """left, right: structs of the rows of both tables whose ranges overlap in one group."""
    a, b = _homed(left, "left", group, start, end), _homed(right, "right", group, start, end)
    levels = lambda df: sorted(r[0] for r in df.select("_level").distinct().collect())
    used = {"left": levels(a), "right": levels(b)}

    def at_home(df: DataFrame) -> DataFrame:
        return df.withColumn("_node", _node("_level")).drop("_low")

    def upwards(df: DataFrame, others: list[int], own: bool) -> DataFrame:
        all_levels = F.array(*[F.lit(n) for n in others]).cast("array<int>")
        above = F.filter(all_levels, lambda n: (n >= F.col("_level")) if own else (n > F.col("_level")))
        return df.withColumn("_level", F.explode(above)).withColumn("_node", _node("_level")).drop("_low")

    key = ["_group", "_level", "_node"]
    around = at_home(a).join(upwards(b, used["left"], True), key)
    within = upwards(a, used["right"], False).join(at_home(b), key)
    met = around.unionByName(within)
    return met.where((F.col("_left_start") <= F.col("_right_end")) & (F.col("_right_start") <= F.col("_left_end"))).select("left", "right")
