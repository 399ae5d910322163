"""The first write that closes an open window, where keys may be unknown: an as-of join that looks ahead.

``windows(scope, base, key, at, ...)`` and ``writes(scope, base, key, at, id)``: a window opens ``at``
a place of the order of its scope, and a later write to its base closes it if the keys
are the same (``same``), or may be, as either is unknown (``maybe``).  A write to another
known key leaves it open.

No pairs of windows and writes are made.  Windows and writes of one key are sorted
together, in buckets of the order so that a key of very many rows is many sorted
groups; what a bucket does not answer takes the first write of a later bucket, from a
table of one row a bucket.  Unknown keys have a side of their own: unknown writes meet
all windows of the base, unknown windows all its writes.

Edge cases: a null key is unknown; a null scope or base is a value like any other; rows
with a null ``at`` are neither opened nor closed (a window then stays open); a write at
the very place of a window is not later; repeated windows are answered each; empty
tables give no windows, or windows that stay open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_following(rows: DataFrame, events: DataFrame, by: list[str], bucket: Column, name: str) -> DataFrame:
    """``rows(by, at, ...)`` with ``name``: the least ``struct(at, id)`` of ``events(by, at, id)`` after it, else null.

    ``bucket``: an expression over ``at`` that grows with it.
    """
    carried = [c for c in rows.columns if c not in (*by, "at")]
    left = rows.select(*by, "at", bucket.alias("_bucket"), F.struct(*carried, F.lit(1).alias("_")).alias("_row"), F.lit(None).cast(events.select(F.struct("at", "id")).schema[0].dataType).alias("_event"))
    right = events.filter("at IS NOT NULL").select(*by, "at", bucket.alias("_bucket"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct("at", "id").alias("_event"))
    # Backwards, what came before is what follows; at one place windows come last, that is first of all backwards.
    backwards = Window.partitionBy(*by, "_bucket").orderBy(F.desc("at"), F.col("_row").isNotNull().desc(), F.desc("_event"))
    inside = left.unionByName(right).withColumn("_found", F.last("_event", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))).filter("_row IS NOT NULL")
    heads = right.groupBy(*by, "_bucket").agg(F.min("_event").alias("_head"))
    places = heads.unionByName(left.select(*by, "_bucket").distinct().withColumn("_head", F.lit(None).cast(heads.schema["_head"].dataType)))
    places = places.groupBy(*by, "_bucket").agg(F.max("_head").alias("_head"))
    ahead = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    later = places.select(*by, "_bucket", F.last("_head", ignorenulls=True).over(ahead).alias("_later")).filter("_later IS NOT NULL")
    other = later.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_b"), "_later")
    same = (F.col("_bucket") == F.col("_b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = inside.join(other, same, "left")
    return found.select(*by, "at", *(F.col(f"_row.{c}").alias(c) for c in carried), F.when(F.col("at").isNotNull(), F.coalesce("_found", "_later")).alias(name))


def closed_by(windows: DataFrame, writes: DataFrame, bucket: Column) -> DataFrame:
    """``windows`` with ``closed_by`` (the write's id, or null) and ``alias``: ``same``, ``maybe`` or, where nothing closes it, ``open``."""
    base, exact = ["scope", "base"], ["scope", "base", "key"]
    known = windows.filter("key IS NOT NULL")
    sure = first_following(known, writes.filter("key IS NOT NULL").select(*exact, "at", "id"), exact, bucket, "_same")
    sure = first_following(sure, writes.filter("key IS NULL").select(*base, "at", "id"), base, bucket, "_maybe")
    open_ = first_following(windows.filter("key IS NULL"), writes.select(*base, "at", "id"), base, bucket, "_maybe")
    both = sure.unionByName(open_.withColumn("_same", F.lit(None).cast(sure.schema["_same"].dataType)))
    is_same = F.col("_same").isNotNull() & (F.col("_maybe").isNull() | (F.col("_same") < F.col("_maybe")))
    out = both.withColumns({"closed_by": F.when(is_same, F.col("_same.id")).otherwise(F.col("_maybe.id")), "alias": F.when(is_same, "same").when(F.col("_maybe").isNotNull(), "maybe").otherwise("open")})
    return out.select(*windows.columns, "closed_by", "alias")
