"""Logistic regressions of many groups at once, by Newton steps that are one aggregation each.

A step sums each group's gradient and second derivatives over its rows, combined before
the shuffle, so that what moves is one row a group and task, and solves each group's
small system by a Cholesky decomposition in columns.  Rows are neither collected nor
brought together by group: a group may hold any share of them.

Weights are balanced if asked for: every class of a group weighs half of its rows.  The penalty
is ``ridge / 2`` times the squared coefficients, the intercept's with them, over the sum of losses, so a
group of one class has finite ones.

Edge cases: rows with a null group, label or feature, or one that is not finite, are left out;
labels are 0 or 1; repeated rows count each; a group whose system cannot be solved keeps
its coefficients and is not ``converged``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rounds import removed, written

#: Groups whose coefficients are sent to every executor at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _solved(a: dict[tuple[int, int], str], g: list[str], m: int, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_d0 ...``: the solution of the symmetric system of the columns ``a`` (lower half) and ``g``."""
    for j in range(m):
        left = F.col(a[j, j]) - sum((F.col(f"_l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"_l{j}_{j}", F.when(left > 0, F.sqrt(left)))
        below = {f"_l{i}_{j}": (F.col(a[i, j]) - sum((F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}_{j}") for i in range(j + 1, m)}
        rows = rows.withColumns(below) if below else rows
    for i in range(m):
        rows = rows.withColumn(f"_y{i}", (F.col(g[i]) - sum((F.col(f"_l{i}_{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"_l{i}_{i}"))
    for i in reversed(range(m)):
        rows = rows.withColumn(f"_d{i}", (F.col(f"_y{i}") - sum((F.col(f"_l{k}_{i}") * F.col(f"_d{k}") for k in range(i + 1, m)), F.lit(0.0))) / F.col(f"_l{i}_{i}"))
    return rows


def fit(rows: DataFrame, group: str, label: str, features: list[str], ridge: float = 1.0, balanced: bool = False, most_steps: int = 25, least_change: float = 1e-9) -> DataFrame:
    """``(group, n, coefficients, change, converged)``: the intercept first, then a coefficient for each of ``features``; ``change``: the largest of the last step."""
    m = len(features) + 1
    x = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(m - 1))]
    own = rows.select(F.col(group).alias("_group"), F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)))
    good = F.col("_group").isNotNull() & F.col("_y").isin(0.0, 1.0)
    for i in range(m - 1):
        good = good & F.col(f"_x{i}").isNotNull() & ~F.isnan(f"_x{i}") & (F.abs(f"_x{i}") < float("inf"))
    own = written(own.filter(good))
    shape = own.groupBy("_group").agg(F.count("*").alias("n"), F.sum("_y").alias("_k"))
    now = written(shape.select("_group", "n", "_k", *(F.lit(0.0).alias(f"_b{i}") for i in range(m)), F.lit(None).cast("double").alias("_change")))
    few = now.count() <= BROADCAST_GROUPS
    # A group's gradient, and the lower half of its second derivatives.
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    for _ in range(most_steps):
        both = own.join(F.broadcast(now) if few else now, "_group")
        p = 1 / (1 + F.exp(-sum((F.col(f"_b{i}") * x[i] for i in range(1, m)), F.col("_b0"))))
        half = F.when(F.col("_y") == 1, F.col("n") / (2 * F.col("_k"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("_k"))))
        weight = half if balanced else F.lit(1.0)
        each = both.select("*", (weight * (F.col("_y") - p)).alias("_r"), (weight * p * (1 - p)).alias("_w"))
        sums = each.groupBy("_group").agg(*(F.sum(F.col("_r") * x[i]).alias(f"_g{i}") for i in range(m)), *(F.sum(F.col("_w") * x[i] * x[j]).alias(f"_h{i}_{j}") for i, j in pairs))
        ready = now.join(sums, "_group").withColumns({f"_g{i}": F.col(f"_g{i}") - ridge * F.col(f"_b{i}") for i in range(m)} | {f"_h{i}_{i}": F.col(f"_h{i}_{i}") + ridge for i in range(m)})
        moved = _solved({(i, j): f"_h{i}_{j}" for i, j in pairs}, [f"_g{i}" for i in range(m)], m, ready)
        step: list[Column] = [F.col(f"_d{i}") for i in range(m)]
        change = F.greatest(*(F.abs(d) for d in step)) if m > 1 else F.abs(step[0])
        sound = step[0].isNotNull() & ~F.isnan(change)
        nxt = written(moved.select("_group", "n", "_k", *(F.when(sound, F.col(f"_b{i}") + step[i]).otherwise(F.col(f"_b{i}")).alias(f"_b{i}") for i in range(m)), F.when(sound, change).alias("_change")))
        removed(now)
        now = nxt
        if now.filter(F.col("_change") > least_change).isEmpty():
            break
    removed(own)
    return now.select(F.col("_group").alias(group), "n", F.array(*(f"_b{i}" for i in range(m))).alias("coefficients"), F.col("_change").alias("change"), F.coalesce(F.col("_change") <= least_change, F.lit(False)).alias("converged"))


def probability(rows: DataFrame, group: str, features: list[str], fitted: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` by the coefficients of their group; null without any."""
    coefficients = fitted.select(F.col(group).alias("_group"), F.col("coefficients").alias("_b"))
    z = sum((F.get("_b", F.lit(i + 1)) * F.col(c) for i, c in enumerate(features)), F.get("_b", F.lit(0)))
    return rows.join(coefficients, rows[group] == F.col("_group"), "left").withColumn("probability", 1 / (1 + F.exp(-z))).drop("_group", "_b")
