"""Findings, per-rule summaries and report invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("TXO-001", "REN-001", "ACC-001", "UEC-001", "TMP-001")
SEVERITIES = ("high", "medium", "low")


def dedup_findings(rows: DataFrame, key: list[str], evidence: str, order: str) -> DataFrame:
    """One row per key; its evidence distinct, in the order first seen."""
    first = rows.groupBy(*key, evidence).agg(F.min(order).alias("_at"))
    return first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", evidence))).alias("_all")).select(*key, F.transform("_all", lambda x: x[evidence]).alias(evidence))


def zero_filled(domain: DataFrame, counts: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """Every member of a small fixed domain with its count, 0 where none was seen."""
    return domain.join(counts, on, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def coverage(reasons: DataFrame, by: list[str], reason: str) -> DataFrame:
    """``partial`` if any rule of the group has a reason, with the sorted distinct reasons."""
    return reasons.groupBy(*by).agg(
        F.when(F.bool_or(F.coalesce(F.col(reason).isNotNull(), F.lit(False))), "partial").otherwise("completed").alias("status"), F.array_sort(F.collect_set(reason)).alias("reasons")
    )


def invariants(reports: DataFrame, findings: DataFrame, results: DataFrame) -> DataFrame:
    """Violations ``(file, problem)``; empty for valid reports.

    ``reports(file, status, total, byte_length)``, ``findings(file, id, rule_id, severity, offset, length)``,
    ``results(file, rule_id, status, reasons)``.
    """
    no = lambda df, problem: df.select("file", F.lit(problem).alias("problem"))
    rules = results.groupBy("file").agg(F.sort_array(F.collect_list("rule_id")).alias("r"))
    count = findings.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    with_count = reports.join(count, "file", "left").fillna(0, ["n", "d"])
    partial = results.groupBy("file").agg(F.bool_or(F.col("status") == "unsupported").alias("p"))
    parts = [
        no(reports.join(rules, "file", "left").filter(~F.coalesce(F.col("r") == F.array(*map(F.lit, sorted(RULES))), F.lit(False))), "rules"),
        no(with_count.filter("n <> d"), "duplicate ids"),
        no(with_count.filter("n <> total"), "total"),
        no(results.filter("(status = 'unsupported') <> (size(reasons) > 0)"), "reasons"),
        no(reports.join(partial, "file").filter("status <> 'failed' AND (status = 'partial') <> p"), "status"),
        no(findings.join(reports.select("file", "byte_length"), "file", "left").filter("byte_length IS NULL OR offset < 0 OR offset + length > byte_length"), "span"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
