"""Classification metrics, latency statistics and rates, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column, empty: float) -> Column:
    """``part / whole``, or ``empty`` where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def confusion(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """True and false positives and negatives of 0/1 columns, per group."""
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    return rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))


def rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Rates of a confusion table; a rate without a denominator is 0 (and specificity 1)."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = {
        "accuracy": _share(tp + tn, tp + fp + tn + fn, 1.0),
        "precision": _share(tp, tp + fp, 0.0),
        "recall": _share(tp, tp + fn, 0.0),
        "f1": _share(2 * tp, 2 * tp + fp + fn, 0.0),
        "specificity": _share(tn, tn + fp, 1.0),
        "fpr": _share(fp, fp + tn, 0.0),
        "fnr": _share(fn, fn + tp, 0.0),
    }
    return counts.withColumns({k: F.round(v, digits) for k, v in out.items()})


def rates_single_class(counts: DataFrame, digits: int = 4) -> DataFrame:
    """As rates(), but a group without positives is perfect unless something is flagged."""
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    none = tp + fn == 0
    clean = (fp == 0).cast("double")
    return rates(counts, digits).withColumns({
        "precision": F.when(none, clean).otherwise(F.col("precision")),
        "recall": F.when(none, 1.0).otherwise(F.col("recall")),
        "f1": F.when(none, clean).otherwise(F.col("f1")),
    })


def brier(rows: DataFrame, by: list[str], y: str = "y", p: str = "p", digits: int = 4) -> DataFrame:
    """Mean squared difference of a probability and a 0/1 outcome."""
    return rows.groupBy(*by).agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), digits).alias("brier"), F.count("*").alias("n"))


def macro_average(table: DataFrame, columns: list[str], by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Mean over groups of values that are already rounded."""
    return table.groupBy(*(by or [])).agg(*(F.round(F.avg(F.round(c, digits)), digits).alias(f"macro_{c}") for c in columns), F.count("*").alias("n_groups"))


def throughput(rows: DataFrame, by: list[str], seconds: str, lines: str, digits: int = 2) -> DataFrame:
    """Runs, lines and thousands of lines a second over all runs of a group; null where they took no time."""
    total, read = F.sum(seconds), F.sum(lines)
    r = lambda c: F.round(c, digits)
    return rows.groupBy(*by).agg(F.count(seconds).alias("n"), r(F.try_divide(F.count(seconds), total)).alias("runs_per_s"), r(F.try_divide(read, total)).alias("loc_per_s"), F.round(F.try_divide(read, total * 1000), digits + 3).alias("kloc_per_s"))


def latency_profile(rows: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """Mean, median, extremes, sample deviation and nearest-rank percentiles of a duration, and the rate 1 / mean."""
    r = lambda c: F.round(c, digits)
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.median(value)).alias("median"), r(F.min(value)).alias("least"), r(F.max(value)).alias("most"),
        r(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("sd"), r(rank(0.95)).alias("p95"), r(rank(0.99)).alias("p99"), r(F.try_divide(F.lit(1.0), F.avg(value))).alias("per_unit"),
    )


def concordance(rows: DataFrame, by: list[str], same: str, digits: int = 4) -> DataFrame:
    """Share of rows for which two judgements agree; 0 without rows."""
    return rows.groupBy(*by).agg(F.count_if(F.col(same)).alias("n_same"), F.count("*").alias("n")).withColumn("rate", F.round(F.col("n_same") / F.greatest("n", F.lit(1)), digits))


def modalities(rows: DataFrame, y: str, judges: dict[str, Column], by: list[str]) -> DataFrame:
    """Metrics of several 0/1 judgements side by side: one row per group and judgement.  One pass over the rows."""
    table = F.explode(F.map_from_arrays(F.array(*map(F.lit, judges)), F.array(*judges.values())))
    long = rows.select(*by, F.col(y).alias("y"), table.alias("modality", "p"))
    return rates(confusion(long, [*by, "modality"]))


def line_counts(texts: DataFrame, by: str, text: str) -> DataFrame:
    """Lines and thousands of lines per category, and of all (category null), in one ROLLUP."""
    lines = F.size(F.split(F.col(text), "\n"))
    return texts.rollup(by).agg(F.count("*").alias("files"), F.sum(lines).cast("long").alias("lines")).withColumn("kloc", F.round(F.col("lines") / 1000, 3))


def argmax_first(rows: DataFrame, by: list[str], score: str, position: str, last_resort: str) -> DataFrame:
    """The row with the largest score per group; a last resort loses ties, then the first position wins."""
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(-F.col(score), F.col(last_resort), F.col(position)))
    return rows.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")
