"""Quantiles from KLL sketches that are kept by part and merged, for profiles over more values than a group can hold.

A sketch has some ``k`` to ``3 k`` values whatever it has seen, is made in parts before any shuffle and can
be stored and merged with others.  The rank of a quantile taken from it is off by about
``1.33 / k ** 0.9`` at most with a confidence of 99 %.

Edge cases: null values are not counted; a group without values has a count of 0 and no
quantiles; a null group is one like any other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400


def sketched(rows: DataFrame, by: list[str], value: Column, k: int = K) -> DataFrame:
    """``by``, the number ``n`` of values, their least, greatest and sum, and their ``sketch``."""
    v = value.cast("double")
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of ``sketched`` put together to groups of fewer keys."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(parts: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """``by, share, n, value``: the quantile of each share."""
    at = F.array(*(F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("value")) for s in shares))
    return parts.filter("n > 0").select(*by, "n", F.explode(at).alias("_at")).select(*by, "_at.share", "n", "_at.value")


def rank_errors(rows: DataFrame, by: list[str], value: Column, found: DataFrame) -> DataFrame:
    """``found`` with ``error``: how far its share lies outside the exact ranks of its value, counted in one pass over ``rows``."""
    table = found.groupBy(*by).agg(F.collect_list(F.struct("share", "n", "value")).alias("_found"))
    own = rows.select(*(F.col(c).alias(f"_{c}") for c in by), value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    each = own.join(table, same).select(*by, "_v", F.explode("_found").alias("f")).groupBy(*by, "f").agg(F.count_if(F.col("_v") < F.col("f.value")).alias("_below"), F.count_if(F.col("_v") <= F.col("f.value")).alias("_upto"))
    low, high = F.col("_below") / F.col("f.n"), F.col("_upto") / F.col("f.n")
    return each.select(*by, "f.*", F.greatest(F.lit(0.0), low - F.col("f.share"), F.col("f.share") - high).alias("error"))
