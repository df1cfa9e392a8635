"""Model and device registries, labels and prediction history, as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.operators.store import page
from meshlight.sources import stored


def active_flags(log: DataFrame) -> DataFrame:
    """Registrations with ``is_active``: of each name, the last one registered as active.

    ``log``: (name, version, trained_at, activate). Registering an active version takes the flag
    from the earlier ones; a repeated (name, version) keeps its first registration.
    """
    first = log.groupBy("name", "version").agg(
        F.min("trained_at").alias("trained_at"), F.min_by("activate", "trained_at").alias("activate")
    )
    last = first.where("activate").groupBy("name").agg(
        F.max(F.struct("trained_at", "version")).alias("_active")
    )
    return first.join(last, "name", "left").select(
        "name",
        "version",
        "trained_at",
        F.coalesce(F.struct("trained_at", "version") == F.col("_active"), F.lit(False)).alias("is_active"),
    )


def active_versions(log: DataFrame) -> DataFrame:
    return active_flags(log).where("is_active").select("name", "version", "trained_at")


def listed(log: DataFrame, limit: int = 100) -> DataFrame:
    """Versions by name, newest first, up to the list's size."""
    return active_flags(log).orderBy("name", F.desc("trained_at"), "version").limit(limit)


def versions_of(log: DataFrame, name: str) -> DataFrame:
    return active_flags(log).where(F.col("name") == name).orderBy(F.desc("trained_at"), "version")


def one_per_name(log: DataFrame) -> DataFrame:
    """One row per model: the active version, or else the newest."""
    best = F.max(F.struct("is_active", "trained_at", "version")).alias("_best")
    return active_flags(log).groupBy("name").agg(best).select(
        "name",
        F.when(F.col("_best.is_active"), F.col("_best.version")).alias("active_version"),
        F.col("_best.version").alias("version"),
        F.col("_best.trained_at").alias("trained_at"),
    )


def inventory(devices: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Registered routers by name, paged; credentials are not part of the table."""
    return page(devices, [F.col("name"), F.col("id")], limit, offset)


def without(devices: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """Registry rows left after deleting by id."""
    return devices.join(removed_ids, "id", "left_anti")


def predictions(scored: DataFrame, model: str, version: str, features: Sequence[str], score: str, as_of: str) -> DataFrame:
    """Prediction history rows with a hash of the input features."""
    inputs = F.to_json(F.struct(*[F.col(f) for f in features]))
    return scored.select(
        "device_id",
        F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.lit(as_of).cast("timestamp").alias("ts"),
        F.col(score).alias("prediction"),
        F.sha2(inputs, 256).alias("features_hash"),
    )


def labels_page(labels: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Manual churn labels, newest first."""
    return page(labels, [F.desc("labeled_at"), F.col("id")], limit, offset)


def label_stats(labels: DataFrame) -> DataFrame:
    total, churned = F.count(F.lit(1)), F.count_if("churned")
    return labels.agg(total.alias("total_labels"), churned.alias("churned_count")).select(
        "total_labels",
        "churned_count",
        (F.col("total_labels") - F.col("churned_count")).alias("retained_count"),
        (F.col("churned_count") / F.greatest("total_labels", F.lit(1))).alias("churn_rate"),
        ((F.col("total_labels") >= 20) & (F.col("churned_count") >= 5)).alias("sufficient_for_training"),
    )



# ------------------------------------------------------------------------------------- stored tables


def register(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add model versions (name, version, ...) to a stored registry; a version keeps its first registration."""
    stored.append(spark, path, rows, ["name", "version"])


def add_labels(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add manual churn labels (id, ...) to a stored table."""
    stored.append(spark, path, rows)


def log_predictions(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add prediction history rows; a device has one prediction of a model version at a time."""
    stored.append(spark, path, rows, ["device_id", "model_name", "model_version", "ts"])
