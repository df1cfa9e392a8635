"""Queries over stored tables: written twice, read once; histories of ingested snapshots; registered models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.operators import anomaly, documents, registry, remediation, segments, serving
from meshlight.plans import jobs
from meshlight.plans.catalog import AS_OF, EV, FLEET, ORACLES, SNAP, query, rounded, ts_sql, ts_text
from meshlight.plans.catalog_ingest import feature_rows
from meshlight.plans.catalog_models import (
    ALIGNED, CENTER_SQL, DENSITY_SQL, GAPS, GIVEN_SQL, KTH_SQL, POINTS_SQL, SCORED_SQL, SEG, churn_rows, fleet_rows, given_forest,
    given_segmentation, merged, stand_in_scores,
)
from meshlight.plans.catalog_rules import churn_labels, decisions, model_log, order_recs, routers
from meshlight.plans.catalog_store import PROBE
from meshlight.plans.catalog_streaming import _ingested
from meshlight.plans.catalog_text import _written_docs
from meshlight.session import work_path, written
from meshlight.sources import history, stored
from meshlight.sources import tables as T


def _halves(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows in two batches, by a hash of the key."""
    first = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    return rows.where(first), rows.where(~first)


# ---------------------------------------------------------------------------------------- writers


@query("stored_labels", sql="SELECT doc_id AS id, toxic = 1 AS churned FROM labels")
def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels sent in two batches, the first of them again with the second."""
    path, rows = work_path(spark, "labels"), churn_labels(spark, sf_dir)
    first, _ = _halves(rows, "id")
    registry.add_labels(spark, path, first)
    registry.add_labels(spark, path, rows)
    return stored.read(spark, path).select("id", "churned")


@query("stored_recommendations", sql=ORACLES["decided_recommendations"])
def stored_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations with their decisions applied in the table, by a job that runs twice."""
    path = work_path(spark, "recommendations")
    for _ in range(2):
        remediation.add_recommendations(spark, path, order_recs(spark, sf_dir))
        remediation.decide(spark, path, decisions(spark, sf_dir))
    return stored.read(spark, path).withColumn("executed_at", ts_text("executed_at"))


@query("stored_chunks", sql=ORACLES["chunk_upsert"])
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks upserted in two batches, the older writes of an id partly after the newer ones."""
    path, rows = work_path(spark, "chunks"), _written_docs(spark, sf_dir)
    for batch in (*_halves(rows, "doc_id"), rows):
        documents.write_chunks(spark, path, batch)
    return stored.read(spark, path).drop("created_at")


@query("stored_registry", sql=ORACLES["model_registry"])
def stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = work_path(spark, "registry"), model_log(spark, sf_dir)
    for batch in (*_halves(rows, "version"), rows):
        registry.register(spark, path, batch)
    return registry.active_flags(stored.read(spark, path)).withColumn("trained_at", ts_text("trained_at"))


@query("stored_predictions", sql=ORACLES["prediction_history"])
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "predictions")
    scores, _ = stand_in_scores(spark, sf_dir)
    rows = registry.predictions(scores, "stand_in", "1", ["latency_idle_ms", "qoe_wan_latest"], "anomaly_score", T.AS_OF)
    rows = written(rows, "predictions")
    for _ in range(2):
        registry.log_predictions(spark, path, rows)
    return rounded(stored.read(spark, path).withColumn("ts", ts_text("ts")))


@query("stored_routers", sql=ORACLES["router_removal"])
def stored_routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routers removed from the stored inventory; one that is sent again stays removed."""
    path, rows = work_path(spark, "routers"), routers(spark, sf_dir)
    stored.append(spark, path, rows)
    poor = T.read(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("id"))
    stored.delete(spark, path, poor)
    stored.append(spark, path, rows)
    return stored.read(spark, path)


# ---------------------------------------------------------------------------------------- history


@query(
    "stored_history",
    sql=f"""SELECT ts, msg_type, feature, value FROM ({ORACLES["feature_snapshots"]}) WHERE device_id = '{PROBE}'
      AND CAST(ts AS TIMESTAMP) BETWEEN TIMESTAMP '{T.WEEK_START}' AND {AS_OF}""",
)
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device's last week from the compacted history of an ingest."""
    out = _ingested(spark, sf_dir)
    history.compact(spark, out)
    rows = history.read_history(spark, out, PROBE, T.WEEK_START, T.AS_OF)
    return feature_rows(rows).drop("device_id")


# ---------------------------------------------------------------------------------------- serving


@query(
    "active_model_scores", EV, SNAP, FLEET, *GIVEN_SQL, SEG, POINTS_SQL, GAPS, KTH_SQL, DENSITY_SQL, CENTER_SQL,
    sql="""SELECT device_id, 'anomaly_detector' AS model_name, 'v2' AS model_version, round(score, 6) AS prediction,
      CASE WHEN score >= 0.7 THEN 'anomaly' ELSE 'normal' END AS label FROM given_scores UNION ALL
      SELECT device_id, 'fleet_clusterer', 'v1', CAST(segment AS DOUBLE), CASE WHEN is_outlier THEN 'outlier' ELSE 'member' END FROM placed""",
)
def active_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a given forest and a given segmentation, saved and registered; scores of the active ones."""
    path = work_path(spark, "models")
    rows, latest = fleet_rows(spark, sf_dir), merged(spark, sf_dir)
    forest = given_forest(latest)
    anomaly.save(forest, spark, f"{path}/forest-2")
    forest.offset = 0.25  # an older version that would score otherwise
    anomaly.save(forest, spark, f"{path}/forest-1")
    segments.save(given_segmentation(rows), spark, f"{path}/segments")
    log = [
        ("anomaly_detector", "v1", "2024-01-01", True, f"{path}/forest-1"), ("anomaly_detector", "v2", "2024-01-02", True, f"{path}/forest-2"),
        ("anomaly_detector", "v3", "2024-01-03", False, f"{path}/none"), ("fleet_clusterer", "v1", "2024-01-01", True, f"{path}/segments"),
        ("churn_predictor", "v1", "2024-01-01", False, f"{path}/none"),
    ]
    frame = spark.createDataFrame(log, "name string, version string, trained_at string, activate boolean, artifact_path string")
    registry.register(spark, f"{path}/registry", frame.withColumn("trained_at", F.col("trained_at").cast("timestamp")))
    fleet = rows.join(latest.select("device_id", "qoe_wan_latest").hint("merge"), "device_id")
    return rounded(serving.active_scores(spark, stored.read(spark, f"{path}/registry"), fleet), 6)


@query(
    "retraining_log", EV, SNAP, FLEET,
    sql=f"""SELECT * FROM (SELECT 'anomaly_detector' AS name, 'IsolationForest' AS algorithm, 21 AS feature_count, count(*) AS rows,
      true AS activate, {ts_sql(AS_OF)} AS trained_at, true AS loaded_alike FROM fleet UNION ALL
      SELECT 'churn_predictor', 'GradientBoosting', 42, (SELECT count(*) FROM fleet), true, {ts_sql(AS_OF)}, true UNION ALL
      SELECT 'fleet_clusterer', 'KMeans', 13, (SELECT count(*) FROM fleet), true, {ts_sql(AS_OF)}, true)""",
)
def retraining_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short retraining, what it registers, and whether each active model scores from its artifact as before saving."""
    rows = written(churn_rows(spark, sf_dir), "fleet")
    found = jobs.retrain_all(spark, rows, T.AS_OF, rounds=3, starts=1)
    log = written(found.log, "model-log")
    served = written(serving.active_scores(spark, log, rows), "served")
    before = {
        "anomaly_detector": anomaly.score(rows, found.anomaly).select("device_id", F.col("anomaly_score").alias("before")),
        "churn_predictor": serving.churn.predict(rows, found.churn).select("device_id", F.col("risk_score").alias("before")),
        "fleet_clusterer": segments.assign(rows, found.segments).select("device_id", F.col("segment").cast("double").alias("before")),
    }
    alike = None
    for name, scores in before.items():
        both = served.where(F.col("model_name") == name).join(scores.hint("merge"), "device_id")
        one = both.agg((F.coalesce(F.max(F.abs(F.col("prediction") - F.col("before"))), F.lit(1.0)) < 1e-9).alias("loaded_alike"))
        one = one.select(F.lit(name).alias("name"), "loaded_alike")
        alike = one if alike is None else alike.union(one)
    count = F.coalesce(F.get_json_object("metrics", "$.n_samples"), F.get_json_object("metrics", "$.n_devices")).cast("bigint")
    return log.join(alike, "name").select(
        "name", "algorithm", "feature_count", count.alias("rows"), "activate", ts_text("trained_at").alias("trained_at"), "loaded_alike"
    )
