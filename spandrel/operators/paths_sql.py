"""Ordered, stateful checks over event logs with window functions: the relational side of path analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def seen_before(rows: DataFrame, by: list[str], order: list[str], what: Column, name: str = "seen") -> DataFrame:
    """Whether an earlier row of the log is ``what``; the row itself doesn't count."""
    before = _log(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.max(what.cast("int")).over(before), F.lit(0)))


def check_call_write(rows: DataFrame, by: list[str], order: list[str], check: Column, call: Column, write: Column) -> DataFrame:
    """Writes with a check before a call before them and no other write in between.

    A write ends every window that is open, so only what follows the last write counts.
    """
    log = _log(by, order)
    before = log.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumns({"_n": F.row_number().over(log), "_check": check, "_call": call, "_write": write})
    era = numbered.withColumn("_era", F.coalesce(F.sum(F.col("_write").cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_era").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    first = era.withColumn("_checked", F.min(F.when(F.col("_check"), F.col("_n"))).over(inside))
    called = first.withColumn("_called", F.max(F.when(F.col("_call") & (F.col("_checked") < F.col("_n")), F.col("_n"))).over(inside))
    return called.filter(F.col("_write") & F.col("_called").isNotNull()).drop("_n", "_check", "_call", "_write", "_era", "_checked", "_called")


def unhandled(rows: DataFrame, by: list[str], order: list[str], failure: Column, handler: Column) -> DataFrame:
    """Failures with no handler before the next failure or the end of the log."""
    log = _log(by, order)
    marked = rows.filter(failure | handler).withColumn("_handler", handler)
    return marked.withColumn("_next", F.lead("_handler").over(log)).filter(~F.col("_handler") & ~F.coalesce("_next", F.lit(False))).drop("_handler", "_next")


def missing_guard(rows: DataFrame, by: list[str], order: list[str], effect: Column, guard: Column) -> DataFrame:
    """Effects with no guard earlier in the log."""
    return seen_before(rows, by, order, guard, "_guarded").filter(effect & (F.col("_guarded") == 0)).drop("_guarded")


def next_is(rows: DataFrame, by: list[str], order: list[str], what: str, name: str = "next") -> DataFrame:
    return rows.withColumn(name, F.lead(what).over(_log(by, order)))


def first_match(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in a total order."""
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order))
    return rows.groupBy(*by).agg(best.alias("_first")).select(*by, "_first.*")


def overlapping_lines(spans: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Spans ``(line, end_line)`` with each line that they touch, by an equi-join on exploded line numbers."""
    each = spans.withColumn("n", F.explode(F.sequence("line", "end_line")))
    return each.join(lines, [*by, "n"])
