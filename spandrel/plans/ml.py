"""Per-rule classifiers over feature rows: fitting, choosing, scoring and fusion with findings."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import active, confidence_bucket
from ..operators.metrics import argmax_first, brier, confusion, rates
from ..operators.rounds import written
from .features import FEATURES

SEED = 42
THRESHOLD = 0.5
TREES = 50
#: Rows that a task of a fit goes through; a fit is hundreds of rounds, each over all partitions.
FIT_ROWS = 20_000


def vector_columns(features: DataFrame, rule: str) -> DataFrame:
    """The features of a rule as double columns ``f0..f7``, missing ones 0."""
    names = FEATURES[rule]
    own = features.filter(F.col("rule_id") == rule)
    return own.select("file", *(F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(names)))


def scaling(rows: DataFrame, width: int = 8) -> list[tuple[float, float]]:
    """Mean and population deviation of each column, 1 for constants."""
    r = rows.agg(*(F.avg(f"f{i}").alias(f"m{i}") for i in range(width)), *(F.stddev_pop(f"f{i}").alias(f"s{i}") for i in range(width))).first()
    return [(r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i in range(width)]


def assembled(rows: DataFrame, scale: list[tuple[float, float]]) -> DataFrame:
    scaled = rows.withColumns({f"f{i}": (F.col(f"f{i}") - m) / s for i, (m, s) in enumerate(scale)})
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(scale))], outputCol="vector").transform(scaled)


class Majority:
    """Gives everything the share of positives, as a baseline."""

    def __init__(self, share: float):
        self.share = float(share >= 0.5)

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", F.lit(self.share))


class Scored:
    def __init__(self, model: Model):
        self.model = model

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def fit(train: DataFrame, valid: DataFrame, trees: int = TREES) -> tuple[str, object, DataFrame]:
    """The best of a baseline, balanced logistic regression and boosted trees by F1 on ``valid``; ties go to the first, but never to the baseline.

    Both have ``vector`` and ``label``; no trees are grown if ``trees`` is 0.  Returns the name, the model and the candidates' metrics.
    """
    shape = train.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    n, k = shape["n"], shape["k"] or 0
    models: dict[str, object] = {"dummy": Majority(k / n if n else 0.0)}
    if 0 < k < n:
        weighted = train.withColumn("w", F.when(F.col("label") == 1, n / (2 * k)).otherwise(n / (2 * (n - k))))
        models["logistic_regression"] = Scored(LogisticRegression(featuresCol="vector", labelCol="label", weightCol="w", maxIter=1000, regParam=1.0 / n, standardization=False).fit(weighted))
        if trees:
            models["boosted_trees"] = Scored(GBTClassifier(featuresCol="vector", labelCol="label", weightCol="w", maxIter=trees, minInstancesPerNode=2, seed=SEED).fit(weighted))
    parts = []
    for i, (name, model) in enumerate(models.items()):
        rows = model.transform(valid).select(F.col("label").alias("y"), F.col("p").alias("q"), (F.col("p") >= THRESHOLD).cast("int").alias("p")).withColumn("candidate", F.lit(name))
        table = rates(confusion(rows, ["candidate"])).join(brier(rows, ["candidate"], "y", "q").drop("n"), "candidate")
        parts.append(table.withColumns({"position": F.lit(i), "is_dummy": F.lit(name == "dummy"), "all": F.lit(1)}))
    metrics = reduce(DataFrame.unionByName, parts)
    best = argmax_first(metrics, ["all"], "f1", "position", "is_dummy").first()
    name = best["candidate"] if best else "dummy"
    return name, models[name], metrics.drop("all")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as their number asks for, whatever shuffle made them."""
    return rows.coalesce(max(1, -(-rows.count() // FIT_ROWS)))


def train(features: DataFrame, labels: DataFrame, splits: DataFrame, trees: int = TREES) -> dict[str, tuple]:
    """Per rule ``(name, model, scale, metrics)``; ``labels(file, rule_id, label)``, a missing one is 0; ``splits(file, part)``."""
    missing = splits.select("file").distinct().join(features.select("file").distinct(), "file", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"files of the splits without features: {[r['file'] for r in missing]}")
    def one(rule: str) -> tuple:
        own = labels.filter(F.col("rule_id") == rule).select("file", "label")
        rows = written(vector_columns(features, rule).join(own, "file", "left").fillna(0, ["label"]).join(splits, "file"))
        known, held = (_dealt(rows.filter(F.col("part") == part)).persist() for part in ("train", "validation"))
        scale = scaling(known)
        name, model, metrics = fit(assembled(known, scale), assembled(held, scale), trees)
        known.unpersist()
        held.unpersist()
        return name, model, scale, metrics

    # A round of a small fit waits for the driver more than it computes, so the rules are fitted side by side.
    with ThreadPoolExecutor(len(FEATURES)) as pool:
        return dict(zip(FEATURES, pool.map(inheritable_thread_target(features.sparkSession)(one), FEATURES), strict=True))


def save(models: dict[str, tuple], folder: str) -> None:
    """Models below ``folder``, one a rule; ``load`` reads them."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = []
    for rule, (name, model, scale, _) in models.items():
        if isinstance(model, Scored):
            model.model.write().overwrite().save(f"{folder}/{rule}")
        rows.append((rule, name, model.share if isinstance(model, Majority) else None, [float(m) for m, _ in scale], [float(s) for _, s in scale], THRESHOLD))
    spark.createDataFrame(rows, "rule_id string, name string, share double, means array<double>, deviations array<double>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/models.parquet")


def load(folder: str) -> dict[str, tuple]:
    """Models by rule; those whose files can't be read are left out."""
    from pyspark.errors import AnalysisException
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
    from pyspark.sql import SparkSession

    kinds = {"logistic_regression": LogisticRegressionModel, "boosted_trees": GBTClassificationModel}
    out = {}
    try:
        rows = SparkSession.active().read.parquet(f"{folder}/models.parquet").collect()
    except AnalysisException:
        return out
    for r in rows:
        try:
            model = Majority(r["share"]) if r["name"] == "dummy" else Scored(kinds[r["name"]].load(f"{folder}/{r['rule_id']}"))
        except Exception:  # noqa: BLE001 - a model that can't be read is a missing one, and readiness() says so
            continue
        out[r["rule_id"]] = (r["name"], model, list(zip(r["means"], r["deviations"], strict=True)), None)
    return out


def readiness(models: dict[str, tuple], enabled: bool = True) -> dict[str, object]:
    """Whether scoring can run: ``ready`` with a model for every rule, ``partial``, ``unavailable`` or ``disabled``."""
    missing = sorted(set(FEATURES) - set(models))
    status = "disabled" if not enabled else "unavailable" if len(missing) == len(FEATURES) else "partial" if missing else "ready"
    return {"status": status, "missing": missing}


def scored(features: DataFrame, models: dict[str, tuple], findings: DataFrame, enabled: bool = True) -> DataFrame:
    """As ``score``, with a row for every file and rule and its ``status``: ``ok``, ``error`` where a rule has no model, ``unavailable`` without any, ``disabled``."""
    state = readiness(models, enabled)["status"]
    every = features.select("file", "rule_id").distinct()
    if state in ("disabled", "unavailable"):
        return every.withColumn("status", F.lit(state))
    rows = score(features, models, findings).withColumn("status", F.lit("ok"))
    return every.join(rows, ["file", "rule_id"], "left").withColumn("status", F.coalesce("status", F.lit("error")))


def shadow(features: DataFrame, models: dict[str, tuple], findings: DataFrame, enabled: bool = False) -> DataFrame | None:
    """Scores beside the rules, which they don't change; none unless switched on and every rule has a model."""
    return score(features, models, findings) if readiness(models, enabled)["status"] == "ready" else None


def score(features: DataFrame, models: dict[str, tuple], findings: DataFrame) -> DataFrame:
    """``(file, rule_id, probability, prediction, confidence, deterministic, concordant, advisory, hybrid, active)``; rules without a model are left out."""
    found = findings.select("file", "rule_id").distinct().withColumn("deterministic", F.lit(1))
    parts = []
    for rule, (_, model, scale, _) in models.items():
        rows = model.transform(assembled(vector_columns(features, rule), scale)).select("file", F.lit(rule).alias("rule_id"), F.round("p", 4).alias("probability"), (F.col("p") >= THRESHOLD).cast("int").alias("prediction"))
        parts.append(rows)
    if not parts:
        raise ValueError("no model")
    rows = reduce(DataFrame.unionByName, parts).join(found, ["file", "rule_id"], "left").fillna(0, ["deterministic"])
    rows = rows.join(features.select("file", "rule_id", active(F.col("features")).alias("active")), ["file", "rule_id"], "left")
    same = F.col("prediction") == F.col("deterministic")
    return rows.withColumns({"confidence": confidence_bucket(F.col("probability")), "concordant": same, "advisory": (F.col("prediction") == 1) & (F.col("deterministic") == 0), "hybrid": F.greatest("prediction", "deterministic")})
