"""Nested values as trees of rows: every object, array and scalar of a VARIANT, level by level.

A level's containers are exploded all at once, with ``variant_explode``, until no container
is left; the number of rounds is the depth of the deepest value.  A node's way down, the
places it takes at each level, sorts it before its children and them before its next
sibling, so numbers in that order are pre-order ids.

Edge cases: a null value has no nodes; a JSON null is a scalar node whose value is null;
an empty object or array is a node without children; keys of an object come in
alphabetical order; text that is no JSON counts as null; repeated keys are answered each,
apart by their rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import removed, written


def walk(rows: DataFrame, value: str) -> DataFrame:
    """All columns of ``rows`` but ``value`` (JSON text), with ``node, parent, depth, name, kind, scalar`` for each node of its value."""
    keys = [c for c in rows.columns if c != value]
    # Equal rows stay apart by a number of their own, made once.
    roots = rows.select(F.struct(*keys).alias("_keys"), F.monotonically_increasing_id().alias("_row"), F.col(value).alias("_json"))
    start = roots.select("_keys", "_row", F.expr("try_parse_json(_json)").alias("_value")).filter("_value IS NOT NULL")
    level = written(start.select("_keys", "_row", F.array().cast("array<int>").alias("_way"), F.lit("$").alias("name"), "_value"))
    levels = [level]
    while True:
        shape = F.expr("schema_of_variant(_value)")
        inner = level.filter(shape.startswith("OBJECT<") | shape.startswith("ARRAY<"))
        exploded = inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_value").outer()).toDF("_pos", "_key", "_inner"))
        name = F.coalesce(F.col("_key"), F.concat(F.lit("["), F.col("_pos"), F.lit("]")))
        level = written(exploded.select("_keys", "_row", F.concat("_way", F.array(F.col("_pos").cast("int"))).alias("_way"), name.alias("name"), F.col("_inner").alias("_value")))
        if level.isEmpty():
            removed(level)
            break
        levels.append(level)
    shape = F.expr("schema_of_variant(_value)")
    kind = F.when(shape.startswith("OBJECT<"), "object").when(shape.startswith("ARRAY<"), "array").otherwise("scalar")
    nodes = reduce(DataFrame.unionByName, levels).select("_keys", "_row", "_way", "name", kind.alias("kind"), F.when(kind == "scalar", F.expr("try_variant_get(_value, '$', 'string')")).alias("scalar"))
    numbered = nodes.withColumn("node", F.row_number().over(Window.partitionBy("_row").orderBy("_way")) - 1).withColumn("depth", F.size("_way"))
    # The parent is the last node before it that is one less deep: a level apart, each node serves as child and as parent.
    sides = numbered.select("*", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("child")), F.struct((F.col("depth") + 1).alias("level"), F.lit(False).alias("child")))).alias("_s"))
    before = Window.partitionBy("_row", "_s.level").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(~F.col("_s.child"), F.col("node")), ignorenulls=True).over(before)
    return sides.withColumn("parent", parent).filter("_s.child").select("_keys.*", "node", "parent", "depth", "name", "kind", "scalar")
