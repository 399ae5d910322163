"""Facts of equality and difference over symbols, in classes, and what contradicts itself.

``facts(scope, left, op, right)`` with ``op`` of ``==`` or ``!=``; a symbol that starts with ``lit:``
is a literal.  What equals is one class, by connected components in each scope; a scope
cannot hold where a difference joins two symbols of one class or a class has two literals.

Edge cases: a fact with a null side or another operator says nothing; repeated facts
count once; a symbol that differs from itself contradicts; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .large_graph import components
from .rounds import written

LITERAL = "lit:"


def classes(facts: DataFrame) -> DataFrame:
    """``(scope, symbol, root)`` of every symbol of a fact: the smallest symbol that it must equal."""
    sides = facts.filter("left IS NOT NULL AND right IS NOT NULL AND op IN ('==', '!=')")
    at = lambda side: F.struct("scope", F.col(side).alias("symbol"))
    joined = components(sides.filter("op = '=='").select(at("left").alias("a"), at("right").alias("b")))
    symbols = sides.select(F.explode(F.array(at("left"), at("right"))).alias("id")).distinct()
    # A scope may be null; as a part of the id it is a value like any other.
    return symbols.join(joined, "id", "left").select("id.scope", "id.symbol", F.coalesce("root.symbol", "id.symbol").alias("root"))


def contradictions(facts: DataFrame, found: DataFrame) -> DataFrame:
    """``(scope, root, left, right, why)`` from ``facts`` and their ``classes``: each difference within a class, and each class with several literals."""
    of = lambda side: found.select(F.col("scope").alias(f"_{side}"), F.col("symbol").alias("_symbol"), F.col("root").alias(f"_{side}_root"))
    apart = facts.filter("op = '!='").select("scope", "left", "right").distinct()
    for side in ("left", "right"):
        other = of(side)
        apart = apart.join(other, apart["scope"].eqNullSafe(other[f"_{side}"]) & (apart[side] == other["_symbol"])).drop("_symbol", f"_{side}")
    different = apart.filter("_left_root = _right_root").select("scope", F.col("_left_root").alias("root"), "left", "right", F.lit("different").alias("why"))
    literals = found.filter(F.col("symbol").startswith(LITERAL)).groupBy("scope", "root").agg(F.min("symbol").alias("left"), F.max("symbol").alias("right")).filter("left <> right")
    return different.unionByName(literals.withColumn("why", F.lit("literals")))


def judged(facts: DataFrame) -> DataFrame:
    """``(scope, root, n_symbols, n_contradictions)`` of each class of two symbols or more, or with a contradiction."""
    facts = written(facts.select("scope", "left", "op", "right").distinct())
    found = written(classes(facts))
    wrong = contradictions(facts, found).groupBy("scope", "root").agg(F.count("*").alias("n_contradictions"))
    sizes = found.groupBy(F.col("scope").alias("_scope"), F.col("root").alias("_root")).agg(F.count("*").alias("n_symbols"))
    out = sizes.join(wrong, F.col("_scope").eqNullSafe(F.col("scope")) & (F.col("_root") == F.col("root")), "left")
    out = out.select(F.col("_scope").alias("scope"), F.col("_root").alias("root"), "n_symbols", F.coalesce("n_contradictions", F.lit(0)).alias("n_contradictions"))
    return out.filter("n_symbols > 1 OR n_contradictions > 0")
