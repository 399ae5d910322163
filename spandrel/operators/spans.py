"""Spans within spans: depths, parents and crossings by one sorted sweep.

``spans(doc, id, start, end)``, end exclusive.  Spans that nest are a forest; a span's parent is the
tightest one that encloses it.  Starts and ends are sorted together and counted up and
down, which tells how many spans enclose each; its parent is then the last span before
it that is one less deep.  Spans are never compared in pairs.  The sweep works in
stretches of a document, which take the count at their start, and the last spans of
each depth, from a small table of stretches, so that a document of very many spans is
many sorted groups.

Spans of one range nest by id, the smaller outside.  Spans that cross (each holds just one
end of the other) are no forest; all of a document with such spans are marked ``tangled``.

Edge cases: spans with a null id or end, or that end before they start, are ignored; an
empty span encloses nothing, and lies within what holds its place strictly; repeated
spans nest in one another; a null document is a value like any other; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import written

#: Places of a document that are swept together.
STRETCH = 65_536
#: Marks that a task sorts, about; there are as many tasks as marks ask for.
TASK_MARKS = 1_000_000


#: Stretches with something before them that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_STRETCHES = 200_000


def _earlier(table: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The stretches of ``table(by, _stretch)`` that have earlier ones, with ``name``: ``value`` over these; keys get a prefix to join by."""
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return written(table.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_stretch").alias("_by_stretch"), value.over(before).alias(name)).filter(F.col(name).isNotNull()))


def _with(rows: DataFrame, earlier: DataFrame, by: list[str]) -> DataFrame:
    same = F.col("_stretch") == F.col("_by_stretch")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    sent = F.broadcast(earlier) if earlier.count() <= BROADCAST_STRETCHES else earlier
    return rows.join(sent, same, "left").drop(*(f"_by_{c}" for c in by), "_by_stretch")


def nested(spans: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(doc, id, start, end, depth, parent, tangled)``; depth 0 and a null parent for what nothing encloses.

    Where a document is tangled, depth counts the spans that are open where one starts.  Spans are
    shuffled once, as two marks each; the sums of stretches are few, and documents of one stretch need none.
    """
    rows = spans.filter("id IS NOT NULL AND start <= end").select("doc", "id", "start", "end")
    marks = rows.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("step")).withColumn("_stretch", F.floor(F.when(F.col("step") == 1, F.col("start")).otherwise(F.col("end")) / stretch))
    stretches = written(marks.groupBy("doc", "_stretch").agg(F.sum("step").alias("_net"), F.count("*").alias("_marks")))
    tasks = max(1, -(-(stretches.agg(F.sum("_marks")).first()[0] or 0) // TASK_MARKS))
    few = spans.sparkSession.sparkContext.defaultParallelism
    base = _earlier(stretches, ["doc"], F.sum("_net"), "_base")
    long = not base.isEmpty()
    empty = F.col("start") == F.col("end")
    # At one place ends come first, then empty spans one by one, then starts, outer ones before inner ones.
    kind = F.when(empty, 1).when(F.col("step") == 1, 2).otherwise(0)
    at = F.when(F.col("step") == 1, F.col("start")).otherwise(F.col("end"))
    inside = Window.partitionBy("doc", "_stretch").orderBy("_at", "_kind", F.col("start") - F.col("end"), "id", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = marks.repartition(max(tasks, few), "doc", "_stretch").withColumns({"_at": at, "_kind": kind})
    counted = dealt.withColumn("_open", F.sum("step").over(inside)).filter("step = 1")
    started = _with(counted, base, ["doc"]) if long else counted.withColumn("_base", F.lit(0))
    starts = started.select("doc", "id", "start", "end", "_stretch", (F.coalesce("_base", F.lit(0)) + F.col("_open") - 1).cast("long").alias("depth"))
    found = written(_parents(starts, base if long else None))
    crossed = written(found.filter("_crossed").select(F.col("doc").alias("_doc")).distinct())
    n = crossed.count()
    if not n:
        return found.select("doc", "id", "start", "end", "depth", "parent", F.lit(False).alias("tangled"))
    tangled = crossed.withColumn("tangled", F.lit(True))
    out = found.join(F.broadcast(tangled) if n <= BROADCAST_STRETCHES else tangled, F.col("doc").eqNullSafe(F.col("_doc")), "left")
    return out.select("doc", "id", "start", "end", "depth", "parent", F.coalesce("tangled", F.lit(False)).alias("tangled"))


def _parents(starts: DataFrame, long: DataFrame | None) -> DataFrame:
    """A row is a child on the level of its depth, and a parent on the next one, where it may be the last before a child.

    ``long`` names the documents of several stretches, whose parents may lie in an earlier one.
    """
    level = lambda n, child: F.struct(n.alias("level"), F.lit(child).alias("child"))
    order = F.struct("start", (F.col("start") < F.col("end")).alias("full"), (-F.col("end")).alias("back"), "id", "depth")
    parent = F.when(~F.col("s.child") & (F.col("start") < F.col("end")), F.struct(order.alias("order"), "id", "end"))

    def sides(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.explode(F.array(level(F.col("depth"), True), level(F.col("depth") + 1, False))).alias("s")).select("*", F.col("s.level").alias("level"))

    before = Window.partitionBy("doc", "_stretch", "level").orderBy("start", F.col("start") < F.col("end"), F.desc("end"), "id", "depth").rowsBetween(Window.unboundedPreceding, -1)
    found = sides(starts).withColumn("_here", F.last(parent, ignorenulls=True).over(before)).filter("s.child")
    if long is None:
        found = found.withColumn("_there", F.lit(None).cast(found.schema["_here"].dataType))
    else:
        docs = long.select(F.col("_by_doc").alias("_doc")).distinct()
        own = starts.join(docs, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
        lasts = sides(own).groupBy("doc", "level", "_stretch").agg(F.max(parent).alias("_last"))
        # A child's level may have no parent in its stretch; every stretch of a document's levels needs its row.
        found = _with(found, _earlier(lasts, ["doc", "level"], F.last("_last", ignorenulls=True), "_there"), ["doc", "level"])
    above = F.coalesce("_here", "_there")
    # What should enclose a span but ends before it does has been crossed.
    crossed = (F.col("depth") > 0) & F.coalesce(above["end"] < F.col("end"), F.lit(True))
    return found.select("doc", "id", "start", "end", "depth", F.when(F.col("depth") > 0, above["id"]).alias("parent"), crossed.alias("_crossed"))


def enclosing(spans: DataFrame, places: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``places(doc, place, ...)`` with ``span``: the tightest span that holds the place, null if none does or the document is tangled.

    A place is swept along as a span of one position that is inside all others of its range.
    """
    numbered = places.select("doc", F.col("place").alias("start")).distinct().withColumns({"end": F.col("start") + 1, "_place": F.lit(1)})
    both = spans.select("doc", F.struct(F.lit(0).alias("place"), F.col("id").alias("id")).alias("id"), "start", "end").unionByName(
        numbered.select("doc", F.struct(F.lit(1).alias("place"), F.lit(None).cast(spans.schema["id"].dataType).alias("id")).alias("id"), "start", "end")
    )
    held = nested(both, stretch).filter("id.place = 1").select(F.col("doc").alias("_doc"), F.col("start").alias("_start"), F.when(~F.col("tangled"), F.col("parent.id")).alias("span"))
    return places.join(held, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("place") == F.col("_start")), "left").drop("_doc", "_start")
