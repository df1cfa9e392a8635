"""From the registry to scores: the active version of a model is looked up, loaded by its kind and applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.operators import anomaly, churn, registry, segments

SCORES = "device_id string, model_name string, model_version string, prediction double, label string"


def _anomaly(spark: SparkSession, path: str, fleet: DataFrame) -> DataFrame:
    rows = anomaly.score(fleet, anomaly.load(spark, path))
    label = F.when(F.col("anomaly_score") >= anomaly.FLAGGED, "anomaly").otherwise("normal")
    return rows.select("device_id", F.col("anomaly_score").alias("prediction"), label.alias("label"))


def _churn(spark: SparkSession, path: str, fleet: DataFrame) -> DataFrame:
    rows = churn.predict(fleet, churn.load(spark, path))
    return rows.select("device_id", F.col("risk_score").alias("prediction"), F.col("risk_level").alias("label"))


def _segments(spark: SparkSession, path: str, fleet: DataFrame) -> DataFrame:
    rows = segments.assign(fleet, segments.load(spark, path))
    label = F.when(F.col("is_outlier"), "outlier").otherwise("member")
    return rows.select("device_id", F.col("segment").cast("double").alias("prediction"), label.alias("label"))


# What loads and applies the artifact of each registered name.
SCORERS: dict[str, Callable[[SparkSession, str, DataFrame], DataFrame]] = {
    "anomaly_detector": _anomaly, "churn_predictor": _churn, "fleet_clusterer": _segments,
}


def active_artifacts(log: DataFrame) -> dict[str, tuple[str, str]]:
    """Version and artifact path of the active version of each model that can be applied: a handful of rows."""
    paths = log.groupBy("name", "version").agg(F.min_by("artifact_path", "trained_at").alias("path"))
    rows = registry.active_versions(log).join(paths, ["name", "version"])
    return {r["name"]: (r["version"], r["path"]) for r in rows.where(F.col("name").isin(list(SCORERS))).collect()}


def active_scores(spark: SparkSession, log: DataFrame, fleet: DataFrame) -> DataFrame:
    """What every active model says of every device; a model without an active version has no rows.

    ``log`` is the registry (name, version, trained_at, activate, artifact_path).
    """
    found = spark.createDataFrame([], SCORES)
    for name, (version, path) in sorted(active_artifacts(log).items()):
        rows = SCORERS[name](spark, path, fleet)
        found = found.unionByName(rows.select(
            "device_id", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), "prediction", "label"
        ))
    return found
