"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


#: Rows of a value from which it may be joined apart, and the most values that are.
LEAST_HOT, MOST_HOT = 1000, 10_000


def by_value(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, a computed table of one row a ``key`` with the number ``n`` of its rows.

    Values with many rows would each land in one task.  Of all counted rows no more than
    1 in MOST_HOT goes to a value for more than MOST_HOT values, so those above that share
    are few at any size; they are sent to every executor and their rows stay where they are.
    """
    least = max(LEAST_HOT, -(-(groups.agg(F.sum(n)).first()[0] or 0) // MOST_HOT))
    hot = groups.filter(F.col(n) > least)
    if hot.isEmpty():
        return rows.join(groups, key)
    apart = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(n) <= least), key)
    return apart.unionByName(rest)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours of a node are linked to the least of them instead."""
    if large:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    moved = by_value(both, least, "u", "n")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of the edges ``(u, v)``: the smallest id reachable.

    The number of rounds grows with the logarithm of the longest path.  Each round's
    edges are written to the checkpoint folder; the driver sees a count and a checksum.
    """
    now = cut(pairs.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        now = cut(_star(_star(now, True), False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.union(now.select("v", "v").distinct()).toDF("id", "component")
