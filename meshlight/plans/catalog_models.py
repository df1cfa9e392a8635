"""Queries over the fleet matrix: preparation, anomalies, churn, segments, forecasts, drift."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.operators import (
    anomaly,
    boosting,
    churn,
    counters,
    drift,
    forecast,
    kmeans,
    modelprep,
    neighbours,
    ordering,
    segments,
    store,
)
from meshlight.plans.catalog import AS_OF, DEVICE_EVENTS, EV, FLEET, SERIES, SNAP, query, rounded, ts_sql, ts_text
from meshlight.plans.catalog_store import COUNTER_SQL
from meshlight.plans.fleet import fleet_matrix
from meshlight.session import work_path, written
from meshlight.sources import tables as T

INPUT = V.ANOMALY_FEATURES
CLUSTER = V.CLUSTER_FEATURES
# The fleet's latest features with the event counters and the age that models ask for besides.
MEASURED = (
    f"{DEVICE_EVENTS}, counted AS ({COUNTER_SQL}), "
    f"ages AS (SELECT device_id, date_diff('day', min(ts), {AS_OF}) AS device_age_days FROM ev GROUP BY 1), "
    "measured AS (SELECT * FROM fleet LEFT JOIN counted USING (device_id) LEFT JOIN ages USING (device_id))"
)


def _aligned_sql(name: str, features: list[str]) -> str:
    columns = ", ".join(f"CAST(coalesce({f}, 0) AS DOUBLE) AS {f}" for f in features)
    return f"{name} AS (SELECT device_id, {columns} FROM measured)"


def _stats_sql(name: str, rows: str, features: list[str]) -> str:
    columns = ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in features
    )
    return f"{name} AS (SELECT {columns} FROM {rows})"


ALIGNED = f"{MEASURED}, {_aligned_sql('aligned', INPUT)}"
STATS = _stats_sql("stats", "aligned", INPUT)
SEG = f"{MEASURED}, {_aligned_sql('seg', CLUSTER)}, {_stats_sql('seg_stats', 'seg', CLUSTER)}"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fleet_merged(T.snapshots(spark, sf_dir), T.SNAPSHOT_FEATURES)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``merged`` with event counters and ages: every feature that the models ask for."""
    counts = counters.event_counters(T.device_events(spark, sf_dir), T.AS_OF)
    ages = counters.device_ages(T.events(spark, sf_dir), T.AS_OF)
    return merged(spark, sf_dir).join(counts.hint("merge"), "device_id", "left").join(ages.hint("merge"), "device_id", "left")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet_matrix(
        T.snapshots(spark, sf_dir), T.device_events(spark, sf_dir), T.heartbeats(spark, sf_dir), T.AS_OF,
        T.SNAPSHOT_FEATURES,
    )


# ------------------------------------------------------------------------------------ preparation


@query("aligned_features", EV, SNAP, FLEET, ALIGNED, sql="SELECT * FROM aligned")
def aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelprep.align(measured(spark, sf_dir), INPUT)


@query(
    "scaled_features", EV, SNAP, FLEET, ALIGNED, STATS,
    sql="SELECT device_id, " + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in INPUT) + " FROM aligned, stats",
)
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelprep.align(measured(spark, sf_dir), INPUT)
    return rounded(modelprep.scaled(rows, modelprep.scaler(rows, INPUT), INPUT), 6)


def _unpivoted(features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT device_id, {i} AS place, '{f}' AS name, {f} AS value, round(abs({f} - m_{f}) / s_{f}, 3) AS zscore "
        "FROM aligned, stats" for i, f in enumerate(features)
    )


RANKED = (
    f"z AS ({_unpivoted(INPUT)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id "
    "ORDER BY zscore DESC, place) AS rank FROM z)"
)


@query(
    "top_features", EV, SNAP, FLEET, ALIGNED, STATS, RANKED,
    sql="SELECT device_id, rank, name, value, zscore FROM ranked WHERE rank <= 5",
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelprep.align(measured(spark, sf_dir), INPUT)
    found = modelprep.top_features(rows, modelprep.scaler(rows, INPUT), INPUT)
    return found.select("device_id", F.posexplode("top_features").alias("p", "f")).select(
        "device_id", (F.col("p") + 1).cast("bigint").alias("rank"), "f.name", "f.value", "f.zscore"
    )


# ---------------------------------------------------------------------------------------- anomaly


def _trained(spark: SparkSession, sf_dir: str) -> tuple[anomaly.Forest, DataFrame]:
    """Forest trained on the fleet matrix, and the matrix, written once for both."""
    rows = written(matrix(spark, sf_dir), "fleet-matrix")
    return anomaly.train(rows), rows


@query("anomaly_training")
def anomaly_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one training run."""
    metrics = anomaly.train(matrix(spark, sf_dir)).metrics
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(metrics.items())], "metric string, value double")


@query("anomaly_scores")
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, rows = _trained(spark, sf_dir)
    return anomaly.score(rows, forest).select("device_id", "anomaly_score")


@query("anomaly_list")
def anomaly_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, rows = _trained(spark, sf_dir)
    return anomaly.listing(anomaly.score(rows, forest), forest.stats, forest.features)


@query("device_anomaly")
def device_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, rows = _trained(spark, sf_dir)
    return anomaly.of_device(rows, forest, "dev-8", spark)


# A small forest with fixed nodes, so that path lengths and scores have an exact oracle.
GIVEN_FEATURES = ["dl_mbps_latest", "latency_idle_ms", "qoe_wan_latest"]
# Fixed by hand: tree, node, feature, threshold, left, right, path.
GIVEN_NODES = [
    (0, 0, 0, 250.0, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 2.5), (0, 2, 1, 20.0, 3, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 5.25), (0, 4, -1, 0.0, 4, 4, 3.0),
    (1, 0, 2, 50.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 1.0), (1, 2, -1, 0.0, 2, 2, 6.5),
    (2, 0, -1, 0.0, 0, 0, 4.0),
]
_GIVEN_PATH = (
    "(CASE WHEN dl <= 250 THEN 2.5 WHEN idle <= 20 THEN 5.25 ELSE 3 END + CASE WHEN wan <= 50 THEN 1 ELSE 6.5 END + 4) / 3.0"
)
GIVEN_SQL = (
    "given AS (SELECT device_id, dl_mbps_latest AS dl, latency_idle_ms AS idle, qoe_wan_latest AS wan FROM "
    "(SELECT device_id, coalesce(dl_mbps_latest, 0) AS dl_mbps_latest, coalesce(latency_idle_ms, 0) AS latency_idle_ms, "
    "coalesce(qoe_wan_latest, 0) AS qoe_wan_latest FROM fleet))",
    f"decided AS (SELECT *, -pow(2.0, -({_GIVEN_PATH}) / {float(anomaly.mean_path(256))!r}) + 0.5 AS raw FROM given)",
    "given_scores AS (SELECT device_id, greatest(0, least(1, 1 - (raw + 0.2) / 0.3)) AS score FROM decided)",
)


def given_forest(rows: DataFrame) -> anomaly.Forest:
    nodes = pd.DataFrame(GIVEN_NODES, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    stats = modelprep.scaler(modelprep.align(rows, GIVEN_FEATURES), GIVEN_FEATURES)
    return anomaly.Forest(GIVEN_FEATURES, nodes, 256, stats, offset=-0.5, low=-0.2, high=0.1)


@query(
    "given_forest_scores", EV, SNAP, FLEET, *GIVEN_SQL,
    sql="SELECT device_id, round(score, 8) AS anomaly_score FROM given_scores",
)
def given_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged(spark, sf_dir)
    return rounded(anomaly.score(rows, given_forest(rows)).select("device_id", "anomaly_score"))


@query(
    "given_device_anomaly", EV, SNAP, FLEET, *GIVEN_SQL,
    sql="SELECT device_id, round(score, 4) AS anomaly_score, score >= 0.7 AS is_anomaly FROM given_scores WHERE device_id = 'dev-8'",
)
def given_device_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged(spark, sf_dir)
    return anomaly.of_device(rows, given_forest(rows), "dev-8", spark).select("device_id", "anomaly_score", "is_anomaly")


@query(
    "anomaly_training_counts", EV, SNAP, FLEET,
    sql=f"""SELECT * FROM (SELECT 'n_samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fleet UNION ALL
      SELECT 'n_features', {float(len(V.ANOMALY_FEATURES))} UNION ALL SELECT 'contamination', 0.05 UNION ALL
      SELECT 'trees', 200.0 UNION ALL SELECT 'rate_fits_count', 1.0)""",
)
def anomaly_training_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a training run does not hang on random numbers."""
    forest, rows = _trained(spark, sf_dir)
    m = forest.metrics
    fits = m["anomaly_rate"] == m["n_anomalies"] / m["n_samples"] and m["n_anomalies"] <= 0.05 * m["n_samples"] + 1
    values = {k: float(m[k]) for k in ("n_samples", "n_features", "contamination")}
    values |= {"trees": float(forest.nodes["tree"].nunique()), "rate_fits_count": float(fits)}
    return spark.createDataFrame(sorted(values.items()), "metric string, value double")


# A fixed stand-in score between 0 and 1, so that everything after the model has an exact oracle.
STAND_IN = "1 - 1 / (1 + dl_mbps_latest / 500 + wifi_avg_retransmit_rate / 20)"
SCORED_SQL = (
    f"scored AS (SELECT aligned.*, coalesce(fleet.wifi_pct_2_4ghz, 0) AS wifi_pct_2_4ghz, raw.anomaly_score FROM aligned "
    "JOIN fleet USING (device_id) JOIN (SELECT device_id, 1 - 1 / (1 + coalesce(dl_mbps_latest, 0) / 500 + "
    "coalesce(wifi_avg_retransmit_rate, 0) / 20) AS anomaly_score FROM fleet) raw USING (device_id))"
)


def stand_in_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows with anomaly_score, scaler row)."""
    rows = modelprep.align(measured(spark, sf_dir), [*INPUT, "wifi_pct_2_4ghz"])
    return rows.withColumn("anomaly_score", F.expr(STAND_IN)), modelprep.scaler(rows, INPUT)


@query(
    "anomaly_score_normalisation", EV, SNAP, FLEET, ALIGNED, SCORED_SQL,
    "bounds AS (SELECT min(0.2 - anomaly_score) AS low, max(0.2 - anomaly_score) AS high FROM scored)",
    sql="SELECT device_id, round(greatest(0, least(1, 1 - ((0.3 - anomaly_score) - low) / (high - low))), 8) AS score "
    "FROM scored, bounds",
)
def anomaly_score_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stand_in_scores(spark, sf_dir)
    raw = 0.2 - F.col("anomaly_score")
    bounds = rows.agg(F.struct(F.min(raw).alias("low"), F.max(raw).alias("high")).alias("b")).scalar()
    placed = rows.withColumn("b", bounds)
    score = anomaly.normalised(0.3 - F.col("anomaly_score"), F.col("b.low"), F.col("b.high"))
    return placed.select("device_id", F.round(score, 8).alias("score"))


@query(
    "anomaly_list_of_scores", EV, SNAP, FLEET, ALIGNED, STATS, SCORED_SQL, RANKED,
    "hits AS (SELECT device_id, round(anomaly_score, 4) AS anomaly_score, count(*) OVER () AS total FROM scored "
    "WHERE anomaly_score >= 0.7)",
    "paged AS (SELECT * FROM hits ORDER BY anomaly_score DESC, device_id LIMIT 50)",
    sql="""SELECT paged.device_id, paged.anomaly_score, true AS is_anomaly, string_agg(name, ',' ORDER BY rank) AS names, total
      FROM paged JOIN ranked USING (device_id) WHERE rank <= 3 GROUP BY ALL""",
)
def anomaly_list_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stats = stand_in_scores(spark, sf_dir)
    found = anomaly.listing(rows, stats, INPUT)
    return found.withColumn("names", F.array_join("top_features.name", ",")).drop("top_features")


@query(
    "decision_threshold",
    sql="""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, count(*) AS rows
      FROM lineitem GROUP BY 1""",
)
def decision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact quantile behind the decision threshold, per group of a large table."""
    rows = T.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = ordering.quantiles(rows, "l_extendedprice", [0.05], by=["l_returnflag"])
    return found.select(
        "l_returnflag", F.round(F.get("quantiles", F.lit(0)), 6).alias("p05"), F.col("total").alias("rows")
    )


# ------------------------------------------------------------------------------------------ churn

CHURN_LABEL_ROWS = "labels"


@query(
    "churn_proxy_labels", EV, SNAP, FLEET,
    "lost AS (SELECT device_id, count(*) AS events_connection_lost_7d FROM ev WHERE k % 7 < 3 "
    f"AND ts > {AS_OF} - INTERVAL 7 DAY AND ts <= {AS_OF} GROUP BY 1)",
    sql="""SELECT device_id, CAST(CASE WHEN coalesce(events_connection_lost_7d, 0) > 5 AND qoe_composite_latest < 50
      THEN 1 ELSE 0 END AS INTEGER) AS churned FROM fleet LEFT JOIN lost USING (device_id)""",
)
def churn_proxy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = (F.col("ts") > F.lit(T.WEEK_START).cast("timestamp")) & (F.col("ts") <= F.lit(T.AS_OF).cast("timestamp"))
    lost = T.events(spark, sf_dir).where(week & (F.col("k") % 7 < 3)).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("events_connection_lost_7d")
    )
    rows = merged(spark, sf_dir).join(lost, "device_id", "left")
    return churn.proxy_labels(rows).select("device_id", "churned")


@query(
    "category_codes",
    "codes AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code FROM "
    "(SELECT DISTINCT p_brand FROM part WHERE p_size <= 25))",
    sql="SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part LEFT JOIN codes USING (p_brand)",
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands coded by the sorted brands of the small parts; brands unseen there are -1."""
    part = T.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return churn.encoded(part.drop("p_size"), part.where("p_size <= 25"), ["p_brand"]).select("p_partkey", "p_brand")


@query(
    "time_folds",
    "placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, "
    "count(*) OVER () AS n FROM orders)",
    sql="""SELECT o_orderkey, position, CAST(CASE WHEN position >= n - 3 * (n // 4)
      THEN (position - (n - 3 * (n // 4))) // (n // 4) + 1 ELSE 0 END AS INTEGER) AS test_fold FROM placed""",
)
def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return churn.expanding_folds(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position", "test_fold")


@query(
    "roc_auc",
    "s AS (SELECT quality, toxic, n_chars AS score FROM labels JOIN documents USING (doc_id))",
    "r AS (SELECT 'quality' AS target, quality AS label, score FROM s UNION ALL SELECT 'toxic', toxic, score FROM s)",
    "mid AS (SELECT target, label, (rank() OVER (PARTITION BY target ORDER BY score) + "
    "count(*) OVER (PARTITION BY target ORDER BY score)) / 2.0 AS place FROM r)",
    sql="""SELECT target, round((sum(place) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * n), 8) AS auc,
      p AS positives, p + n AS rows FROM mid JOIN (SELECT target, count(*) FILTER (WHERE label = 1) AS p,
      count(*) FILTER (WHERE label = 0) AS n FROM r GROUP BY 1) USING (target) GROUP BY target, p, n""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    rows = T.read(spark, sf_dir, "labels").join(docs, "doc_id")
    long = rows.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("label")) for c in ("quality", "toxic")])), "score"
    )
    return rounded(churn.auc(long, by=["target"]))


_RISK = "least(100 * (1 - 1 / (1 + coalesce(dl_mbps_latest, 0) / 700)) + coalesce(qoe_worst_category, 0) * 4, 100)"
RISK_SQL = (
    f"risk AS (SELECT device_id, risk_score, CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 50 THEN 'medium' "
    f"WHEN risk_score < 75 THEN 'high' ELSE 'critical' END AS risk_level FROM (SELECT device_id, {_RISK} AS risk_score FROM fleet))"
)


def stand_in_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged(spark, sf_dir).withColumn("risk_score", F.expr(_RISK))
    return rows.withColumn("risk_level", churn.risk_level(F.col("risk_score")))


@query(
    "risk_levels", EV, SNAP, FLEET, RISK_SQL,
    sql="SELECT device_id, round(risk_score, 6) AS risk_score, risk_level FROM risk",
)
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stand_in_risk(spark, sf_dir).select("device_id", "risk_score", "risk_level"), 6)


@query(
    "risk_list", EV, SNAP, FLEET, RISK_SQL,
    "hits AS (SELECT device_id, CAST(printf('%.1f', risk_score) AS DOUBLE) AS risk_score, risk_level, "
    "count(*) OVER () AS total FROM risk WHERE risk_level IN ('high', 'critical'))",
    sql="SELECT device_id, device_id AS subscriber_id, risk_score, risk_level, total FROM hits "
    "ORDER BY risk_score DESC, device_id LIMIT 50 OFFSET 10",
)
def risk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stand_in_risk(spark, sf_dir).select("device_id", "risk_score", "risk_level")
    return churn.risk_list(rows, " High, critical", offset=10)


@query(
    "churn_factors", EV, SNAP, FLEET,
    sql="""SELECT device_id, printf('dl_mbps_latest=%.1f (importance=0.400);qoe_worst_category=%.1f (importance=0.200);'
      || 'wifi_avg_rssi=%.1f (importance=0.200)', coalesce(dl_mbps_latest, 0), coalesce(qoe_worst_category, 0),
      coalesce(wifi_avg_rssi, 0)) AS factors FROM fleet""",
)
def churn_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"qoe_worst_category": 0.2, "dl_mbps_latest": 0.4, "wifi_avg_rssi": 0.2, "latency_idle_ms": 0.1}
    rows = churn.top_factors(merged(spark, sf_dir), weights, 3)
    return rows.select("device_id", F.array_join("top_factors", ";").alias("factors"))


@query(
    "subscriber_risk", EV, SNAP, FLEET, RISK_SQL,
    sql="""SELECT 'dev-' || c_custkey AS device_id, coalesce(round(risk_score, 1), 0) AS risk_score,
      coalesce(risk_level, 'low') AS risk_level FROM customer LEFT JOIN risk ON device_id = 'dev-' || c_custkey""",
)
def subscriber_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = T.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id")
    )
    return churn.of_subscriber(stand_in_risk(spark, sf_dir), asked)


def churn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet matrix with manual labels: quality of the document that carries the device's number."""
    manual = T.read(spark, sf_dir, "labels").select(
        F.concat(F.lit("dev-"), F.col("doc_id").cast("string")).alias("device_id"),
        (F.col("quality") == 0).alias("churned"),
        F.lit(T.AS_OF).cast("timestamp").alias("labeled_at"),
    )
    return churn.labelled(matrix(spark, sf_dir), manual)


# Two small boosted trees with fixed nodes: tree, node, feature, threshold, left, right, value.
GIVEN_BOOSTED = [
    (0, 0, 0, 300.0, 1, 2, 0.0), (0, 1, 1, 12.5, 3, 4, 0.0), (0, 2, -1, 0.0, 2, 2, -0.4), (0, 3, -1, 0.0, 3, 3, 0.9), (0, 4, -1, 0.0, 4, 4, 0.25),
    (1, 0, 2, 40.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 0.7), (1, 2, 0, 600.0, 3, 4, 0.0), (1, 3, -1, 0.0, 3, 3, -0.1), (1, 4, -1, 0.0, 4, 4, -0.6),
]
_NODE_VALUES = ", ".join(f"({', '.join(map(str, n))})" for n in GIVEN_BOOSTED)


@query(
    "given_boosted_margins", "RECURSIVE " + EV, SNAP, FLEET,
    f"nodes(tree, node, feature, threshold, low, high, value) AS (VALUES {_NODE_VALUES})",
    "rows_ AS (SELECT device_id, [coalesce(dl_mbps_latest, 0), coalesce(latency_idle_ms, 0), coalesce(qoe_wan_latest, 0)] AS x FROM fleet)",
    "walk AS (SELECT device_id, x, tree, 0 AS node FROM rows_, (SELECT DISTINCT tree FROM nodes) UNION ALL "
    "SELECT w.device_id, w.x, w.tree, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n.low ELSE n.high END "
    "FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0)",
    sql="""SELECT device_id, round(CAST(-1.2 + sum(value) AS DOUBLE), 8) AS margin FROM walk JOIN nodes USING (tree, node) WHERE feature < 0
      GROUP BY device_id""",
)
def given_boosted_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of given trees, saved and loaded."""
    trees = [boosting.Tree(), boosting.Tree()]
    for tree, _, feature, threshold, left, right, value in GIVEN_BOOSTED:
        at = trees[tree].add(value)
        trees[tree].feature[at], trees[tree].threshold[at], trees[tree].left[at], trees[tree].right[at] = feature, threshold, left, right
    path = work_path(spark, "boosted")
    boosting.save(boosting.Boosted(GIVEN_FEATURES, -1.2, trees, [0.0] * 3), spark, path)
    rows = modelprep.align(merged(spark, sf_dir), GIVEN_FEATURES)
    return rounded(rows.select("device_id", boosting.margin(boosting.load(spark, path)).alias("margin")))


@query("churn_predictions")
def churn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled matrix and score every device."""
    rows = written(churn_rows(spark, sf_dir), "churn-rows")
    model = churn.train(rows)
    scored = churn.predict(rows, model)
    weights = dict(zip(model.features, model.importances, strict=True))
    return churn.top_factors(scored, weights).select("device_id", "risk_score", "risk_level", "top_factors")


# --------------------------------------------------------------------------------------- segments

POINTS_SQL = "points AS (SELECT device_id AS id, [" + ", ".join(
    f"({f} - m_{f}) / s_{f}" for f in CLUSTER
) + "] AS vec FROM seg, seg_stats)"
GAPS = (
    "gaps AS (SELECT a.id, b.id AS other, list_distance(a.vec, b.vec) AS d FROM points a, points b)"
)


def fleet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's segment features, written once for all that is made of them."""
    return written(modelprep.align(measured(spark, sf_dir), CLUSTER), "fleet-rows")


def points(rows: DataFrame) -> DataFrame:
    return written(segments.vectors(modelprep.scaled(rows, modelprep.scaler(rows, CLUSTER), CLUSTER), CLUSTER), "points")


KTH_SQL = (
    "size AS (SELECT greatest(10, count(*) // 200) AS k FROM points), "
    "kth AS (SELECT id, d AS distance FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rank FROM gaps), "
    "size WHERE rank = k)"
)


@query(
    "neighbour_distances", EV, SNAP, FLEET, SEG, POINTS_SQL, GAPS, KTH_SQL,
    sql="SELECT id, round(distance, 8) AS distance FROM kth",
)
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(fleet_rows(spark, sf_dir))
    return rounded(neighbours.kth_distance(rows, segments.neighbours_needed(rows.count())))


KNEE_SQL = (
    "curve AS (SELECT distance, row_number() OVER (ORDER BY distance) AS i, lag(distance) OVER (ORDER BY distance) AS p, "
    "lead(distance) OVER (ORDER BY distance) AS q FROM kth), "
    "knee AS (SELECT distance AS eps FROM curve WHERE p IS NOT NULL AND q IS NOT NULL "
    "ORDER BY (q - distance) - (distance - p) DESC, i LIMIT 1)"
)


@query(
    "density_radius", EV, SNAP, FLEET, SEG, POINTS_SQL, GAPS, KTH_SQL, KNEE_SQL,
    sql="SELECT round(eps, 8) AS eps FROM knee",
)
def density_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(fleet_rows(spark, sf_dir))
    return rounded(segments.knee(neighbours.kth_distance(rows, segments.neighbours_needed(rows.count()))))


DENSITY_SQL = (
    "cores AS (SELECT id FROM gaps, size WHERE d <= 3.0 GROUP BY id, k HAVING count(*) >= k), "
    "touched AS (SELECT DISTINCT gaps.id FROM gaps JOIN cores ON cores.id = other WHERE d <= 3.0)"
)


@query(
    "density_outliers", EV, SNAP, FLEET, SEG, POINTS_SQL, GAPS, KTH_SQL, DENSITY_SQL,
    sql="""SELECT id, id IN (SELECT id FROM cores) AS core, id NOT IN (SELECT id FROM touched) AS noise FROM points""",
)
def density_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(fleet_rows(spark, sf_dir))
    return segments.density(rows, 3.0, segments.neighbours_needed(rows.count())).select("id", "core", "noise")


CENTER_SQL = (
    "centers AS (SELECT CAST(g AS INTEGER) AS segment, [" + ", ".join(
        f"avg(({f} - m_{f}) / s_{f})" for f in CLUSTER
    ) + "] AS center FROM (SELECT *, least(floor(dl_mbps_latest / 400), 3) AS g FROM seg), seg_stats GROUP BY 1), "
    "near AS (SELECT DISTINCT gaps.id FROM gaps JOIN cores ON cores.id = other WHERE d <= 3.0), "
    "best AS (SELECT id, arg_min(segment, d) AS segment, min(d) AS distance FROM (SELECT id, segment, "
    "list_distance(vec, center) AS d FROM points, centers) GROUP BY 1), "
    "placed AS (SELECT best.id AS device_id, near.id IS NULL AS is_outlier, CASE WHEN near.id IS NULL THEN -1 "
    "ELSE segment END AS segment, CASE WHEN near.id IS NOT NULL THEN distance END AS distance "
    "FROM best LEFT JOIN near USING (id))"
)


def given_segmentation(rows: DataFrame) -> segments.Segmentation:
    """A segmentation whose centroids are group means of the data (at most four groups)."""
    stats = modelprep.scaler(rows, CLUSTER)
    dense = segments.density(points(rows), 3.0, segments.neighbours_needed(rows.count()))
    return segments.Segmentation(CLUSTER, stats, 3.0, dense.where("core").select("id", "vec"), _group_centers(rows, 400, 3))


def _group_centers(rows: DataFrame, step: int, last: int) -> np.ndarray:
    """Means of the scaled devices by download rate, in steps of ``step`` up to group ``last``."""
    group = F.least(F.floor(F.col("dl_mbps_latest") / step), F.lit(last)).alias("g")
    flat = modelprep.scaled(rows, modelprep.scaler(rows, CLUSTER), CLUSTER, ("device_id",)).join(rows.select("device_id", group).hint("merge"), "device_id")
    centers = flat.groupBy("g").agg(*[F.avg(f).alias(f) for f in CLUSTER]).orderBy("g").collect()
    return np.array([[c[f] for f in CLUSTER] for c in centers])


def assigned(rows: DataFrame) -> DataFrame:
    return segments.assign(rows, given_segmentation(rows))


GIVEN = (EV, SNAP, FLEET, SEG, POINTS_SQL, GAPS, KTH_SQL, DENSITY_SQL, CENTER_SQL)


@query(
    "segment_assignment", *GIVEN,
    sql="SELECT device_id, CAST(segment AS INTEGER) AS segment, is_outlier, round(distance, 6) AS distance FROM placed",
)
def segment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assigned(fleet_rows(spark, sf_dir)), 6)


_LABEL_SQL = """coalesce(nullif(concat_ws(' ',
  CASE WHEN avg(qoe_composite_latest) >= 85 THEN 'High-QoE' WHEN avg(qoe_composite_latest) < 60 THEN 'Low-QoE' END,
  CASE WHEN avg(dl_mbps_latest) >= 500 THEN 'High-Speed' WHEN avg(dl_mbps_latest) < 100 THEN 'Low-Speed' END,
  CASE WHEN avg(wifi_client_count) >= 15 THEN 'Heavy-Use' WHEN avg(wifi_client_count) <= 3 THEN 'Light-Use' END,
  CASE WHEN avg(traffic_streaming_pct) > 0.5 THEN 'Streamers' END), ''), 'Standard')"""



def _two_digits(x: str) -> str:
    """Half to even: odd eighths are the only numbers that lie exactly between two results."""
    return f"CASE WHEN {x} * 8 = floor({x} * 8) AND {x} * 4 <> floor({x} * 4) THEN round_even({x}, 2) ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END"


SUMMARY_SQL = (
    "described AS (SELECT CAST(segment AS INTEGER) AS segment, count(*) AS devices, "
    + ", ".join(f"{_two_digits(f'avg({f})')} AS avg_{f}" for f in CLUSTER)
    + f", {_LABEL_SQL} AS label, segment = -1 AS is_outlier FROM placed JOIN seg USING (device_id) GROUP BY segment)"
)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fleet_rows(spark, sf_dir)
    return segments.summary(rows, assigned(rows))


@query("segment_summary", *GIVEN, SUMMARY_SQL, sql="SELECT * FROM described")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["segment", "devices", *[f"avg_{f}" for f in CLUSTER], "label", "is_outlier"]
    return described(spark, sf_dir).select(*kept)


@query(
    "segments_view", *GIVEN, SUMMARY_SQL,
    sql="""SELECT segment, label, devices, avg_qoe_composite_latest, avg_dl_mbps_latest,
      (SELECT CAST(coalesce(sum(devices), 0) AS BIGINT) FROM described WHERE is_outlier) AS outliers
      FROM described WHERE NOT is_outlier""",
)
def segments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments_view(described(spark, sf_dir))


@query(
    "segment_members", *GIVEN,
    sql="""SELECT device_id, (SELECT count(*) FROM placed WHERE segment = 1) AS total FROM placed WHERE segment = 1
      ORDER BY device_id LIMIT 50""",
)
def segment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.members(assigned(fleet_rows(spark, sf_dir)), 1)


@query(
    "assignment_table", *GIVEN, SUMMARY_SQL,
    sql=f"""SELECT device_id, described.segment, label, placed.is_outlier, round(distance, 6) AS distance,
      {ts_sql(AS_OF)} AS assigned_at FROM placed JOIN described ON described.segment = placed.segment""",
)
def assignment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet = fleet_rows(spark, sf_dir)
    placed = written(assigned(fleet), "assigned")
    rows = segments.assignment_table(placed, segments.summary(fleet, placed), T.AS_OF)
    return rounded(rows.withColumn("assigned_at", ts_text("assigned_at")), 6)


@query(
    "segment_silhouette", EV, SNAP, FLEET, SEG, POINTS_SQL,
    "labelled AS (SELECT id, vec, least(floor(dl_mbps_latest / 400), 3) AS g FROM points JOIN seg ON id = device_id)",
    "sized AS (SELECT g, count(*) AS n FROM labelled GROUP BY 1)",
    "pair AS (SELECT a.id, a.g, b.g AS other, sum(pow(list_distance(a.vec, b.vec), 2)) AS d FROM labelled a, labelled b GROUP BY ALL)",
    "means AS (SELECT id, pair.g, other, CASE WHEN pair.g = other THEN d / greatest(n - 1, 1) ELSE d / n END AS m, n FROM pair "
    "JOIN sized ON other = sized.g)",
    "widths AS (SELECT id, max(CASE WHEN g = other THEN m END) AS inside, max(CASE WHEN g = other THEN n END) AS own, "
    "min(CASE WHEN g <> other THEN m END) AS outside FROM means GROUP BY id)",
    sql="SELECT round(avg(CASE WHEN own > 1 THEN (outside - inside) / greatest(outside, inside) ELSE 0 END), 6) AS silhouette FROM widths",
)
def segment_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of given segments: the devices by their download rate."""
    rows = fleet_rows(spark, sf_dir)
    rate = rows.select(F.col("device_id").alias("id"), F.least(F.floor(F.col("dl_mbps_latest") / 400), F.lit(3)).alias("prediction"))
    value = segments.silhouette(points(rows).join(rate.hint("merge"), "id"))
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query(
    "segment_step", *GIVEN,
    sql="""SELECT CAST(segment AS INTEGER) AS segment, CAST(p AS INTEGER) AS place, count(*) AS devices,
      round(avg(vec[p]), 5) AS value FROM best JOIN points USING (id), range(1, 14) t(p) GROUP BY ALL""",
)
def segment_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of k-means from given centroids: the centroids after it, number by number."""
    rows = fleet_rows(spark, sf_dir)
    moved, sizes, _ = kmeans.step(points(rows), [_group_centers(rows, 400, 3)])
    found = [
        (segment, place + 1, int(n), round(float(x), 5))
        for segment, (center, n) in enumerate(zip(moved[0], sizes[0])) for place, x in enumerate(center) if n
    ]
    return spark.createDataFrame(found, "segment int, place int, devices bigint, value double")


# Given models: the devices' means by download rate, in steps of so many Mbps up to the last group.
SWEEP = {2: (800, 1), 4: (400, 3)}


def _sweep_sql() -> str:
    parts = []
    for k, (step, last) in SWEEP.items():
        means = ", ".join(f"avg(({f} - m_{f}) / s_{f})" for f in CLUSTER)
        parts += [
            f"c{k} AS (SELECT g AS segment, [{means}] AS center FROM (SELECT *, least(floor(dl_mbps_latest / {step}), {last}) AS g "
            "FROM seg), seg_stats GROUP BY 1)",
            f"l{k} AS (SELECT id, any_value(vec) AS vec, arg_min(segment, list_distance(vec, center)) AS g FROM points, c{k} GROUP BY id)",
            f"n{k} AS (SELECT g, count(*) AS n FROM l{k} GROUP BY 1)",
            f"p{k} AS (SELECT a.id, a.g, b.g AS other, sum(pow(list_distance(a.vec, b.vec), 2)) AS d FROM l{k} a, l{k} b GROUP BY ALL)",
            f"m{k} AS (SELECT id, p.g, other, CASE WHEN p.g = other THEN d / greatest(n - 1, 1) ELSE d / n END AS m, n "
            f"FROM p{k} p JOIN n{k} s ON other = s.g)",
            f"w{k} AS (SELECT id, max(CASE WHEN g = other THEN m END) AS inside, max(CASE WHEN g = other THEN n END) AS own, "
            f"min(CASE WHEN g <> other THEN m END) AS outside FROM m{k} GROUP BY id)",
        ]
    rows = " UNION ALL ".join(
        f"SELECT {k} AS k, avg(CASE WHEN own > 1 THEN (outside - inside) / greatest(outside, inside) ELSE 0 END) AS s FROM w{k}" for k in SWEEP
    )
    return ", ".join(parts) + f", swept AS ({rows})"


@query(
    "segment_sweep", EV, SNAP, FLEET, SEG, POINTS_SQL, _sweep_sql(),
    sql="SELECT k, round(s, 6) AS silhouette, s = (SELECT max(s) FROM swept) AS chosen FROM swept",
)
def segment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of given models, and which number of segments they choose."""
    rows = fleet_rows(spark, sf_dir)
    found = kmeans.silhouettes(points(rows), [_group_centers(rows, *SWEEP[k]) for k in SWEEP])
    out = [(k, round(s, 6), s == max(found)) for k, s in zip(SWEEP, found)]
    return spark.createDataFrame(out, "k int, silhouette double, chosen boolean")


@query("fleet_segments")
def fleet_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the segmentation on the fleet matrix and describe its segments."""
    rows = written(matrix(spark, sf_dir), "segment-matrix")
    model = segments.train(rows)
    return segments.summary(rows, segments.assign(rows, model))


# --------------------------------------------------------------------------------------- forecast

STEPS_SQL = (
    "steps AS (SELECT device_id, CAST(floor(epoch_us(ts) / 900000000.0) AS BIGINT) AS step, avg(value) AS value, "
    f"max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM series WHERE ts > {AS_OF} - INTERVAL 7 DAY AND ts <= {AS_OF} "
    "GROUP BY 1, 2)"
)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.steps(T.series(spark, sf_dir), T.AS_OF)


@query(
    "forecast_input", EV, SERIES, STEPS_SQL,
    sql="""SELECT device_id, step, round(steps.value, 8) AS value FROM (SELECT device_id, unnest(range(min(step), max(step) + 1))
      AS step FROM steps GROUP BY 1) LEFT JOIN steps USING (device_id, step)""",
)
def forecast_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.gap_filled(resampled(spark, sf_dir)))


@query(
    "forecast_summary", EV, SERIES, STEPS_SQL,
    "have AS (SELECT device_id, count(*) AS n, arg_max(last_value, last_ts) AS current, max(last_ts) AS last_ts FROM steps GROUP BY 1)",
    "devices AS (SELECT DISTINCT device_id FROM series UNION SELECT 'dev-' || c_custkey FROM customer)",
    sql=f"""SELECT device_id, coalesce(n, 0) AS points, CASE WHEN coalesce(n, 0) < 48 THEN 'none' WHEN n < 96 THEN 'no_season'
      WHEN n < 672 THEN 'short_season' ELSE 'full_season' END AS tier, {ts_sql('last_ts')} AS last_ts,
      coalesce(CAST(printf('%.2f', current) AS DOUBLE), 0) AS current,
      CASE WHEN n IS NULL THEN '{V.FORECAST_WARNINGS["none"]}' WHEN n < 48 THEN '{V.FORECAST_WARNINGS["short"]}' END AS warning
      FROM devices LEFT JOIN have USING (device_id)""",
)
def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id")
    )
    devices = T.series(spark, sf_dir).select("device_id").union(known).distinct()
    return forecast.summary(devices, resampled(spark, sf_dir)).withColumn("last_ts", ts_text("last_ts"))


def _points_shown(rows: DataFrame) -> DataFrame:
    return forecast.presented(rows).withColumn("ts", ts_text("ts"))


def _clip_sql(text: str) -> str:
    return f"CAST(printf('%.2f', greatest(0, least(100, {text}))) AS DOUBLE)"


@query(
    "moving_average_forecast", EV, SERIES, STEPS_SQL,
    "recent AS (SELECT device_id, avg(value) AS m, coalesce(stddev_samp(value), 5.0) AS s, max(last_ts) AS last_ts FROM "
    "(SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY step DESC) AS r FROM steps) WHERE r <= 96 GROUP BY 1)",
    sql=f"""SELECT device_id, CAST(i AS INTEGER) AS i, {ts_sql('last_ts + to_minutes(CAST(15 * i AS INTEGER))')} AS ts,
      {_clip_sql('m')} AS predicted, {_clip_sql('m - 2 * s')} AS lower95, {_clip_sql('m + 2 * s')} AS upper95
      FROM recent, range(1, 97) t(i)""",
)
def moving_average_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points_shown(forecast.moving_average(resampled(spark, sf_dir)))


SEASONAL_SQL = (
    "heads AS (SELECT device_id, count(*) AS points, max(step) AS last_step, max(last_ts) AS end_ts FROM steps GROUP BY 1 "
    "HAVING count(*) >= 48), "
    "line AS (SELECT device_id, regr_slope(value, step - last_step) AS b, regr_intercept(value, step - last_step) AS a "
    "FROM steps JOIN heads USING (device_id) GROUP BY 1), "
    "off AS (SELECT device_id, points, step % 96 AS slot, value - a - b * (step - last_step) AS o FROM steps "
    "JOIN heads USING (device_id) JOIN line USING (device_id)), "
    "prof AS (SELECT device_id, slot, CASE WHEN max(points) >= 96 THEN avg(o) ELSE 0 END AS season FROM off GROUP BY 1, 2), "
    "sig AS (SELECT device_id, sqrt(sum((o - season) * (o - season)) / greatest(count(*) - 1, 1)) AS sigma FROM off "
    "JOIN prof USING (device_id, slot) GROUP BY 1), "
    "future AS (SELECT device_id, i, end_ts, a + b * i + coalesce(season, 0) AS m, sigma FROM heads JOIN line USING (device_id) "
    "JOIN sig USING (device_id) CROSS JOIN range(1, 673) t(i) LEFT JOIN prof p ON p.device_id = heads.device_id "
    "AND p.slot = (last_step + i) % 96)"
).replace("SELECT device_id, i, end_ts", "SELECT heads.device_id, i, end_ts")


@query(
    "seasonal_forecast", EV, SERIES, STEPS_SQL, SEASONAL_SQL,
    sql=f"""SELECT device_id, CAST(i AS INTEGER) AS i, {ts_sql('end_ts + to_minutes(CAST(15 * i AS INTEGER))')} AS ts,
      {_clip_sql('m')} AS predicted, {_clip_sql('m - 1.96 * sigma')} AS lower95, {_clip_sql('m + 1.96 * sigma')} AS upper95
      FROM future""",
)
def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points_shown(forecast.seasonal(resampled(spark, sf_dir), V.WEEK_STEPS))


@query(
    "forecast_trend", EV, SERIES, STEPS_SQL, SEASONAL_SQL,
    "ends AS (SELECT device_id, (arg_max(p, i) - arg_min(p, i)) / count(*) * 4 AS per_hour FROM "
    "(SELECT device_id, i, greatest(0, least(100, m)) AS p FROM future WHERE i <= 96) GROUP BY 1)",
    sql="""SELECT device_id, CASE WHEN per_hour > 0.5 THEN 'improving' WHEN per_hour < -0.5 THEN 'declining'
      ELSE 'stable' END AS trend FROM ends""",
)
def forecast_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.trend(forecast.seasonal(resampled(spark, sf_dir)))


# ------------------------------------------------------------------------------------------ drift

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLIT = "1998-06-01"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.read(spark, sf_dir, "lineitem").select("l_shipdate", *MEASURES)
    # Orders shipped late are dearer in the current sample, so that one feature drifts.
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp")
    current = rows.where(~early).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5)
    return rows.where(early), current


LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS feature, l_shipdate >= TIMESTAMP '{SPLIT}' AS cur, CASE WHEN l_shipdate >= TIMESTAMP '{SPLIT}' "
    f"THEN {m} * {1.5 if m == 'l_extendedprice' else 1} ELSE {m} END AS value FROM lineitem" for m in MEASURES
) + ")"
PSI_SQL = (
    "edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) "
    "AS e FROM long WHERE NOT cur GROUP BY 1), "
    "bins AS (SELECT feature, unnest(range(1, len(e))) AS bin, e FROM edges), "
    "held AS (SELECT feature, cur, CASE WHEN value < e[1] OR value > e[-1] THEN 0 WHEN value = e[-1] THEN len(e) - 1 "
    "ELSE len(list_filter(e, lambda x: x <= value)) END AS bin, count(*) AS n FROM long JOIN edges USING (feature) GROUP BY ALL), "
    "shares AS (SELECT bins.feature, bins.bin, (coalesce(max(n) FILTER (WHERE NOT cur), 0) + 1) / "
    "((SELECT count(*) FROM long l WHERE l.feature = bins.feature AND NOT l.cur) + 10.0) AS r, "
    "(coalesce(max(n) FILTER (WHERE cur), 0) + 1) / ((SELECT count(*) FROM long l WHERE l.feature = bins.feature AND l.cur) + 10.0) "
    "AS c FROM bins LEFT JOIN held ON held.feature = bins.feature AND held.bin = bins.bin GROUP BY 1, 2), "
    "psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM shares GROUP BY 1)"
)
KS_SQL = (
    "cdf AS (SELECT feature, value, sum(count(*) FILTER (WHERE NOT cur)) OVER w AS r, sum(count(*) FILTER (WHERE cur)) OVER w AS c, "
    "sum(count(*) FILTER (WHERE NOT cur)) OVER f AS nr, sum(count(*) FILTER (WHERE cur)) OVER f AS nc FROM long "
    "GROUP BY feature, value WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)), "
    "ks AS (SELECT feature, max(abs(r / nr - c / nc)) AS d, CAST(max(nr) AS DOUBLE) * max(nc) / (max(nr) + max(nc)) AS ne "
    "FROM cdf GROUP BY 1), "
    "tail AS (SELECT feature, d, CASE WHEN sqrt(ne) * d < 0.5 THEN 1 - sqrt(2 * pi()) / (sqrt(ne) * d) * "
    "list_sum(list_transform(range(1, 21), lambda j: exp(-((2 * j - 1) * (2 * j - 1)) * pi() * pi() / (8 * ne * d * d)))) "
    "ELSE 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * "
    "exp(-2 * j * j * ne * d * d))) END AS p FROM ks)"
)


@query("psi", LONG_SQL, PSI_SQL, sql="SELECT feature, round(psi, 6) AS psi FROM psi")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = _halves(spark, sf_dir)
    counts = drift.both(drift.long_form(reference, MEASURES), drift.long_form(current, MEASURES))
    return rounded(drift.psi(counts), 6)


@query(
    "sketched_psi", LONG_SQL,
    sql="""SELECT feature, count(*) FILTER (WHERE NOT cur) AS reference_rows, count(*) FILTER (WHERE cur) AS current_rows,
      true AS within_bound FROM long GROUP BY 1""",
)
def sketched_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI between two spans of days from daily sketches, held against the exact one."""
    reference, current = _halves(spark, sf_dir)
    sketches = written(drift.daily_sketches(reference.unionByName(current), MEASURES, "l_shipdate"), "daily-sketches")
    day = F.col("day")
    found = drift.sketched_psi(sketches, day < F.lit(SPLIT).cast("date"), day >= F.lit(SPLIT).cast("date"))
    counts = drift.both(drift.long_form(reference, MEASURES), drift.long_form(current, MEASURES))
    close = F.abs(F.col("psi") - F.col("exact")) <= 0.01 + 0.05 * F.col("exact")
    return found.join(drift.psi(counts).withColumnRenamed("psi", "exact"), "feature").select(
        "feature", "reference_rows", "current_rows", close.alias("within_bound")
    )


@query(
    "ks_test", LONG_SQL, KS_SQL,
    sql="""SELECT feature, round(d, 8) AS ks_statistic, round(least(1, greatest(0, p)), 6) AS ks_p_value,
      least(1, greatest(0, p)) < 0.05 AS ks_drifted FROM tail""",
)
def ks_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = _halves(spark, sf_dir)
    counts = drift.both(drift.long_form(reference, MEASURES), drift.long_form(current, MEASURES))
    found = drift.ks(counts)
    return found.select(
        "feature", F.round("ks_statistic", 8).alias("ks_statistic"), F.round("ks_p_value", 6).alias("ks_p_value"), "ks_drifted"
    )


@query(
    "drift_report", LONG_SQL, PSI_SQL, KS_SQL,
    sql="""SELECT feature, round(psi, 4) AS psi, round(d, 4) AS ks_statistic, round(least(1, greatest(0, p)), 4) AS ks_p_value,
      psi > 0.25 OR least(1, greatest(0, p)) < 0.05 AS is_drifted,
      CASE WHEN psi > 0.25 THEN 'high' WHEN psi > 0.10 THEN 'moderate' ELSE 'low' END AS severity
      FROM psi JOIN tail USING (feature)""",
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, current = _halves(spark, sf_dir)
    return drift.report(reference, current, MEASURES)
