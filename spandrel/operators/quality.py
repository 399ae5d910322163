"""Data-quality checks: violations as rows, empty when the data is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITIONS = ("train", "validation", "locked_test")
LABELS = ("present", "absent", "unknown", "not_applicable", "unsupported")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``(key, problem)`` for each failed check of each row; one pass over the rows."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())))
    return rows.select(F.col(key), F.explode(failed).alias("problem"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().filter(F.col("count") > 1).select(key)


def validate_annotations(rows: DataFrame) -> DataFrame:
    """Problems of annotation rows ``(sample_id, rule_id, label, sha256, reviewed)``."""
    from .report import RULES

    empty = F.coalesce(F.trim("sample_id"), F.lit("")) == ""
    own = violations(rows, "sample_id", {
        "empty id": empty,
        "rule": ~F.col("rule_id").isin(*RULES),
        "label": ~F.col("label").isin(*LABELS),
        "hash": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "not reviewed": F.col("label").isin("present", "absent") & ~F.coalesce("reviewed", F.lit(False)),
    })
    return own.unionByName(duplicates(rows, "sample_id").withColumn("problem", F.lit("duplicate id")))


def family_leakage(rows: DataFrame, family: str, partition: str) -> DataFrame:
    """Families that lie in more than one partition from which is learnt or on which is tested."""
    return rows.filter(F.col(partition).isin(*PARTITIONS)).groupBy(family).agg(F.array_sort(F.collect_set(partition)).alias("partitions")).filter(F.size("partitions") > 1)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return both.select(key, F.when(F.col("_l").isNull(), "right only").otherwise("left only").alias("side"))


def conjunction(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that match all filters; an empty one matches everything."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]) if kv[1] else df, wanted.items(), rows)


def validate_splits(splits: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, problem)``: files in more than one part or in none, unknown parts, and split files that don't exist."""
    named = splits.withColumn("_bad", ~F.col("part").isin(*PARTITIONS))
    per_file = named.groupBy("file").agg(F.countDistinct("part").alias("parts"), F.bool_or("_bad").alias("bad"))
    both = per_file.join(files.select("file").distinct().withColumn("_here", F.lit(True)), "file", "full_outer")
    return violations(both, "file", {
        "several parts": F.coalesce("parts", F.lit(0)) > 1,
        "unknown part": F.coalesce("bad", F.lit(False)),
        "no part": F.col("parts").isNull(),
        "no file": F.col("_here").isNull(),
    })


def validate_manifest(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, problem)`` of manifest rows ``(id, file, category, line, text, evidence ARRAY<INT>, expected ARRAY<INT>)``.

    A row's line must still read as it says, and its evidence must hold all expected lines.
    """
    lines = F.split(F.regexp_replace("source", "\r\n", "\n"), "\n")
    both = rows.join(sources.select("file", "source"), "file", "left")
    at = F.try_element_at(lines, F.greatest(F.col("line"), F.lit(1)))
    own = violations(both, "id", {
        "id": ~F.coalesce(F.col("id").rlike("^[A-Z]{2,4}-[0-9]{3}$"), F.lit(False)),
        "category": F.coalesce(F.trim("category"), F.lit("")) == "",
        "no file": F.col("source").isNull(),
        "line": F.col("source").isNotNull() & (~F.coalesce(F.col("line").between(1, F.size(lines)), F.lit(False))),
        "stale text": F.col("source").isNotNull() & (F.trim(F.coalesce(at, F.lit(""))) != F.trim("text")),
        "evidence": F.size(F.array_except("expected", "evidence")) > 0,
    })
    return own.unionByName(duplicates(rows, "id").withColumn("problem", F.lit("duplicate id")))
