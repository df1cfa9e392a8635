"""Queries over alerts, remediation, recommendations, executions, labels and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.operators import alerts, modelprep, registry, remediation, temporal
from meshlight.plans import jobs
from meshlight.plans.catalog import AS_OF, EV, FLEET, SNAP, query, rounded, ts_sql, ts_text
from meshlight.plans.catalog_models import (
    ALIGNED,
    INPUT,
    RANKED,
    SCORED_SQL,
    STATS,
    churn_rows,
    merged,
    stand_in_scores,
)
from meshlight.sources import tables as T


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


# ----------------------------------------------------------------------------------------- alerts

RULES = _values("rules", "rule_id, label, feature, op, threshold, severity, impact", V.ALERT_RULES)
FIRED = (
    "measured AS (" + " UNION ALL ".join(
        f"SELECT device_id, '{f}' AS feature, {f} AS value FROM fleet" for f in sorted({r[2] for r in V.ALERT_RULES})
    ) + "), fired AS (SELECT device_id, rule_id, label, severity, impact, feature, value, CAST(threshold AS DOUBLE) AS threshold, "
    "op AS operator FROM measured JOIN rules USING (feature) WHERE CASE op WHEN 'gt' THEN value > threshold "
    "ELSE value < threshold END)"
)


@query("alert_rules", EV, SNAP, FLEET, RULES, FIRED, sql="SELECT * FROM fired")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.evaluate(merged(spark, sf_dir))


_CUSTOM = [
    ("price_top", "Dear line", "l_extendedprice", "gte", 60000.0, "warning", "medium"),
    ("price_low", "Cheap line", "l_extendedprice", "lte", 1000.0, "info", "low"),
    ("full", "Full pallet", "l_quantity", "eq", 50.0, "info", "low"),
    ("odd", "Unknown operator", "l_quantity", "about", 50.0, "info", "low"),
    ("absent", "Missing feature", "l_weight", "gt", 0.0, "info", "low"),
]


@query(
    "alert_custom_rules",
    sql="""SELECT rule_id, operator, count(*) AS alerts, CAST(min(value) AS DOUBLE) AS lowest FROM (
      SELECT 'price_top' AS rule_id, 'gte' AS operator, l_extendedprice AS value FROM lineitem WHERE l_extendedprice >= 60000
      UNION ALL SELECT 'price_low', 'lte', l_extendedprice FROM lineitem WHERE l_extendedprice <= 1000
      UNION ALL SELECT 'full', 'eq', l_quantity FROM lineitem WHERE l_quantity = 50) GROUP BY 1, 2""",
)
def alert_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem")
    fired = alerts.evaluate(rows, _CUSTOM, keep=("l_orderkey",))
    return fired.groupBy("rule_id", "operator").agg(
        F.count(F.lit(1)).alias("alerts"), F.min("value").alias("lowest")
    )


@query(
    "alert_texts", EV, SNAP, FLEET, RULES, FIRED,
    sql="""SELECT device_id, rule_id, 'Alert: ' || label AS title,
      feature || '=' || printf('%.1f', value) || ' ' || operator || ' ' || CAST(threshold AS VARCHAR) AS text FROM fired""",
)
def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.alert_text(alerts.evaluate(merged(spark, sf_dir)))
    return rows.select("device_id", "rule_id", "title", "text")


# ------------------------------------------------------------------------------------- diagnosis

DIAGNOSED = (
    _values("zrules", "name, diagnosis, least", V.DIAGNOSIS_RULES)
    + ", hits AS (SELECT device_id, arg_min(diagnosis, rank) AS hit FROM ranked JOIN zrules USING (name) "
    "WHERE rank <= 5 AND zscore >= least GROUP BY 1), "
    "mild AS (SELECT device_id, count(*) AS n FROM ranked WHERE rank <= 5 AND zscore >= 1.5 GROUP BY 1), "
    "diag AS (SELECT device_id, anomaly_score, CASE WHEN wifi_pct_2_4ghz > 0.6 THEN 'band_congestion' "
    "WHEN hit IS NOT NULL THEN hit WHEN coalesce(n, 0) >= 3 THEN 'degraded_general' ELSE 'none' END AS diagnosis "
    "FROM scored LEFT JOIN hits USING (device_id) LEFT JOIN mild USING (device_id))"
)
PLANNED = (
    _values("remedies", "diagnosis, action, title, description, auto, impact", V.REMEDIES)
    + ", planned AS (SELECT diag.device_id, diag.diagnosis, anomaly_score, action, title, description, auto, impact, "
    "CASE WHEN action IS NOT NULL THEN anomaly_score END AS confidence FROM diag LEFT JOIN remedies USING (diagnosis))"
)
BASE = (EV, SNAP, FLEET, ALIGNED, STATS, SCORED_SQL, RANKED, DIAGNOSED, PLANNED)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stats = stand_in_scores(spark, sf_dir)
    return modelprep.top_features(rows, stats, INPUT, 5)


@query("diagnosis", *BASE, sql="SELECT device_id, diagnosis FROM diag")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.diagnose(explained(spark, sf_dir)).select("device_id", "diagnosis")


@query(
    "remediation_plan", *BASE,
    sql="SELECT device_id, diagnosis, action, title, description, auto, impact, round(confidence, 8) AS confidence FROM planned",
)
def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.plan(remediation.diagnose(explained(spark, sf_dir)))
    return rounded(
        rows.select("device_id", "diagnosis", "action", "title", "description", "auto", "impact", "confidence")
    )


ROUTED = (
    "routed AS (SELECT *, CASE WHEN action IS NULL THEN 'end' WHEN auto AND confidence >= 0.8 THEN 'execute' "
    "ELSE 'escalate' END AS route FROM planned)"
)


@query(
    "remediation_route", *BASE, ROUTED,
    sql="""SELECT device_id, route, CASE route WHEN 'execute' THEN 'executed' WHEN 'escalate' THEN 'escalated'
      ELSE 'diagnosed' END AS status FROM routed""",
)
def remediation_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.plan(remediation.diagnose(explained(spark, sf_dir)))
    return remediation.route(rows, auto_enabled=True).select("device_id", "route", "status")


# Past runs of the agent: one per error event.
RUNS = (
    "runs AS (SELECT CAST(event_id AS VARCHAR) AS id, device_id, ts AS completed_at, v / 400 AS anomaly_score "
    "FROM ev WHERE event_type = 'error')"
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("id"),
        "device_id",
        F.col("ts").alias("started_at"),
        F.col("ts").alias("completed_at"),
        (F.col("v") / 400).alias("anomaly_score"),
    )


COOLING = f"cooling AS (SELECT DISTINCT device_id FROM runs WHERE completed_at > {AS_OF} - INTERVAL 4 HOUR)"


@query(
    "fleet_scan", *BASE, RUNS, COOLING,
    sql="""SELECT device_id, round(anomaly_score, 8) AS anomaly_score, diagnosis, action,
      CASE WHEN action IS NULL THEN 'end' ELSE 'escalate' END AS route FROM planned
      WHERE anomaly_score >= 0.5 AND device_id NOT IN (SELECT device_id FROM cooling)""",
)
def fleet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.fleet_scan(explained(spark, sf_dir), runs(spark, sf_dir), T.AS_OF)
    return rounded(found.select("device_id", "anomaly_score", "diagnosis", "action", "route"))


RECS = (
    f"recs AS (SELECT substr(sha256(device_id || ':{T.AS_OF}:' || action), 1, 36) AS id, device_id, action AS type, title, "
    "description, diagnosis, confidence, impact FROM planned WHERE action IS NOT NULL AND anomaly_score >= 0.5 "
    "AND device_id NOT IN (SELECT device_id FROM cooling))"
)


def recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = jobs.fleet_scan(explained(spark, sf_dir), runs(spark, sf_dir), T.AS_OF)
    return remediation.recommendations(scan, T.AS_OF)


@query(
    "recommendations", *BASE, RUNS, COOLING, RECS,
    sql=f"""SELECT id, device_id, type, title, description, diagnosis, round(confidence, 8) AS confidence, impact,
      false AS auto_executable, 'pending' AS status, {ts_sql(AS_OF)} AS created_at, '{V.AGENT_MODEL[0]}' AS model_name,
      '{V.AGENT_MODEL[1]}' AS model_version FROM recs""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recs(spark, sf_dir).withColumn("created_at", ts_text("created_at")))


_CHANNELS = _values("channels", "impact, channel", [(i, c) for i, cs in V.IMPACT_CHANNELS.items() for c in cs])
_MARKS = _values("marks", "impact, mark", list(V.IMPACT_MARKS.items()))


@query(
    "notification_outbox", *BASE, RUNS, COOLING, RECS, _CHANNELS, _MARKS,
    sql="""SELECT id AS recommendation_id, device_id, impact, channel,
      '[Fleet] Agent Alert: ' || title || ' (' || device_id || ')' AS subject,
      mark || ' *Fleet Agent Alert*' || chr(10) || 'Device `' || device_id || '` needs attention.' || chr(10)
      || '*Diagnosis:* ' || diagnosis || chr(10) || '*Recommendation:* ' || title || chr(10) || '*Confidence:* '
      || printf('%.0f', confidence * 100) || '% | *Impact:* ' || upper(impact) || chr(10) || 'Review in the Admin Console.' AS text
      FROM recs JOIN channels USING (impact) JOIN marks USING (impact)""",
)
def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.outbox(recs(spark, sf_dir))


@query(
    "execution_audit", *BASE, RUNS, COOLING,
    sql=f"""SELECT substr(sha256(device_id || ':{T.AS_OF}'), 1, 36) AS id, device_id, diagnosis, action AS recommended_action,
      CASE WHEN action IS NULL THEN 'diagnosed' ELSE 'escalated' END AS status, false AS auto_executed FROM planned
      WHERE anomaly_score >= 0.5 AND device_id NOT IN (SELECT device_id FROM cooling)""",
)
def execution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = jobs.fleet_scan(explained(spark, sf_dir), runs(spark, sf_dir), T.AS_OF)
    rows = remediation.executions(scan, T.AS_OF)
    return rows.select("id", "device_id", "diagnosis", "recommended_action", "status", "auto_executed")


@query(
    "run_verification", EV, RUNS,
    "scores AS (SELECT device_id, ts, v / 400 AS score FROM ev WHERE event_type = 'view')",
    sql="""SELECT id, runs.device_id, anomaly_score AS before, score AS after, coalesce(score < anomaly_score, false) AS verified
      FROM runs ASOF LEFT JOIN scores ON runs.device_id = scores.device_id AND runs.completed_at < scores.ts""",
)
def run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = T.events(spark, sf_dir).where("event_type = 'view'").select(
        "device_id", "ts", (F.col("v") / 400).alias("score")
    )
    return remediation.verified(runs(spark, sf_dir), scores)


@query(
    "run_history", EV, RUNS,
    sql=f"""SELECT id, device_id, {ts_sql('completed_at')} AS started_at, (SELECT count(*) FROM runs) AS total FROM runs
      ORDER BY completed_at DESC, id LIMIT 50""",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.run_history(runs(spark, sf_dir))
    return rows.select("id", "device_id", ts_text("started_at").alias("started_at"), "total")


@query(
    "scan_summary", *BASE, RUNS, COOLING,
    sql="""SELECT (SELECT count(*) FROM runs) AS total_runs, (SELECT count(*) FROM cooling) AS cooldown_devices,
      (SELECT count(*) FROM scored WHERE anomaly_score >= 0.5) AS flagged""",
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = stand_in_scores(spark, sf_dir)
    return remediation.scan_summary(scores, runs(spark, sf_dir), T.AS_OF)


# ------------------------------------------------------------------- recommendations as a table

ORDER_RECS = (
    "orecs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'dev-' || o_custkey AS device_id, o_totalprice / 500000 AS confidence, "
    "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'dismissed' END AS status FROM orders)"
)
DECISIONS = (
    "decisions AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_shipdate + to_seconds(l_partkey) + "
    "to_milliseconds(l_suppkey) + to_microseconds(l_linenumber) AS decided_at, "
    "CASE WHEN l_returnflag = 'A' THEN 'approved' ELSE 'dismissed' END AS status, "
    "'user-' || l_suppkey AS decided_by FROM lineitem)"
)


def order_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved")
    return T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("dev-"), F.col("o_custkey").cast("string")).alias("device_id"),
        (F.col("o_totalprice") / 500000).alias("confidence"),
        status.otherwise("dismissed").alias("status"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = (
        F.unix_micros("l_shipdate") + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")
    )
    return T.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.timestamp_micros(micros).alias("decided_at"),
        F.when(F.col("l_returnflag") == "A", "approved").otherwise("dismissed").alias("status"),
        F.concat(F.lit("user-"), F.col("l_suppkey").cast("string")).alias("decided_by"),
    )


@query("pending_recommendations", ORDER_RECS, sql="SELECT * FROM orecs WHERE status = 'pending'")
def pending_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.pending(order_recs(spark, sf_dir))


@query(
    "decided_recommendations", ORDER_RECS, DECISIONS,
    "last AS (SELECT id, arg_max(status, decided_at) AS s, arg_max(decided_by, decided_at) AS b, max(decided_at) AS t "
    "FROM decisions GROUP BY 1)",
    sql=f"""SELECT id, device_id, confidence, coalesce(s, status) AS status,
      CASE WHEN s = 'approved' THEN {ts_sql('t')} END AS executed_at, CASE WHEN s = 'approved' THEN b END AS executed_by
      FROM orecs LEFT JOIN last USING (id)""",
)
def decided_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.decided(order_recs(spark, sf_dir), decisions(spark, sf_dir))
    return rows.withColumn("executed_at", ts_text("executed_at"))


@query(
    "unknown_decisions", ORDER_RECS, DECISIONS,
    sql="SELECT status, count(*) AS decisions FROM decisions WHERE id NOT IN (SELECT id FROM orecs WHERE status = 'pending') GROUP BY 1",
)
def unknown_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_recs = order_recs(spark, sf_dir).where("status = 'pending'")
    found = remediation.unknown_decisions(open_recs, decisions(spark, sf_dir))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("decisions"))


# ----------------------------------------------------------------------------- labels, registries


def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("churned"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("labeled_at"),
    )


@query(
    "churn_labels",
    sql="""SELECT doc_id AS id, toxic = 1 AS churned, (SELECT count(*) FROM labels) AS total FROM labels
      ORDER BY doc_id DESC LIMIT 50""",
)
def churn_label_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.labels_page(churn_labels(spark, sf_dir)).drop("labeled_at")


@query(
    "churn_label_stats",
    sql="""SELECT count(*) AS total_labels, count(*) FILTER (WHERE toxic = 1) AS churned_count,
      count(*) FILTER (WHERE toxic <> 1) AS retained_count,
      round(count(*) FILTER (WHERE toxic = 1) / greatest(count(*), 1), 8) AS churn_rate,
      count(*) >= 20 AND count(*) FILTER (WHERE toxic = 1) >= 5 AS sufficient_for_training FROM labels""",
)
def churn_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(registry.label_stats(churn_labels(spark, sf_dir)))


MODEL_LOG = (
    "log AS (SELECT 'model-' || o_orderpriority AS name, 'v' || o_orderkey AS version, o_orderdate AS trained_at, "
    "o_orderstatus = 'F' AS activate FROM orders), "
    "flags AS (SELECT name, version, trained_at, row_number() OVER (PARTITION BY name ORDER BY activate DESC, "
    "trained_at DESC, version DESC) = 1 AND activate AS is_active FROM log)"
)


def model_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("model-"), "o_orderpriority").alias("name"),
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"),
        F.col("o_orderdate").alias("trained_at"),
        (F.col("o_orderstatus") == "F").alias("activate"),
    )


def _with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("trained_at", ts_text("trained_at"))


@query(
    "model_registry", MODEL_LOG, sql=f"SELECT name, version, {ts_sql('trained_at')} AS trained_at, is_active FROM flags"
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_time(registry.active_flags(model_log(spark, sf_dir)))


@query(
    "active_models", MODEL_LOG,
    sql=f"SELECT name, version, {ts_sql('trained_at')} AS trained_at FROM flags WHERE is_active",
)
def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_time(registry.active_versions(model_log(spark, sf_dir)))


@query(
    "model_list", MODEL_LOG,
    sql=f"""SELECT name, version, {ts_sql('trained_at')} AS trained_at, is_active FROM flags
      ORDER BY name, flags.trained_at DESC, version LIMIT 100""",
)
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_time(registry.listed(model_log(spark, sf_dir)))


@query(
    "model_versions", MODEL_LOG,
    sql=f"SELECT name, version, {ts_sql('trained_at')} AS trained_at, is_active FROM flags WHERE name = 'model-1-URGENT'",
)
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_time(registry.versions_of(model_log(spark, sf_dir), "model-1-URGENT"))


@query(
    "models_one_per_name", MODEL_LOG,
    sql=f"""SELECT name, CASE WHEN is_active THEN version END AS active_version, version, {ts_sql('trained_at')} AS trained_at
      FROM flags QUALIFY row_number() OVER (PARTITION BY name ORDER BY is_active DESC, flags.trained_at DESC, version DESC) = 1""",
)
def models_one_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_time(registry.one_per_name(model_log(spark, sf_dir)))


def routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query(
    "router_inventory",
    sql="""SELECT s_suppkey AS id, s_name AS name, (SELECT count(*) FROM supplier) AS total FROM supplier
      ORDER BY s_name, s_suppkey LIMIT 50""",
)
def router_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.inventory(routers(spark, sf_dir))


@query("router_removal", sql="SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE NOT s_acctbal < 1000")
def router_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = T.read(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("id"))
    return registry.without(routers(spark, sf_dir), removed)


@query(
    "prediction_history", EV, SNAP, FLEET, ALIGNED, SCORED_SQL,
    sql=f"""SELECT device_id, 'stand_in' AS model_name, '1' AS model_version, {ts_sql(AS_OF)} AS ts,
      round(anomaly_score, 8) AS prediction, sha256('{{"latency_idle_ms":' || latency_idle_ms || ',"qoe_wan_latest":' ||
      qoe_wan_latest || '}}') AS features_hash FROM scored""",
)
def prediction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stand_in_scores(spark, sf_dir)
    found = registry.predictions(rows, "stand_in", "1", ["latency_idle_ms", "qoe_wan_latest"], "anomaly_score", T.AS_OF)
    return rounded(found.withColumn("ts", ts_text("ts")))


@query("model_retraining")
def model_retraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train all three models on the labelled fleet matrix and return the registry rows."""
    rows = churn_rows(spark, sf_dir)
    return jobs.retrain_all(spark, rows, T.AS_OF).log.drop("artifact_path")


# ---------------------------------------------------------------------------------------- flagship

FLAGSHIP_WINDOW = (
    "series AS (SELECT device_id, ts, v AS value FROM ev), last AS (SELECT device_id, max(ts) AS last_ts FROM series GROUP BY 1), "
    "win AS (SELECT device_id, ts, value, last_ts FROM series JOIN last USING (device_id) WHERE ts > last_ts - INTERVAL 7 DAY), "
    "stats AS (SELECT device_id, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std, min(value) AS min, "
    "max(value) AS max, count(*) AS count, CASE WHEN count(*) > 1 THEN round(regr_slope(value, "
    "(epoch_us(ts) - epoch_us(last_ts)) / 86400000000.0), 6) ELSE 0 END AS slope FROM win GROUP BY 1)"
)


@query(
    "fleet_health", EV, SNAP, FLEET, RULES, FIRED, FLAGSHIP_WINDOW,
    sql=f"""SELECT device_id, {ts_sql('fleet.ts')} AS ts, stats.mean, std, min, max, count, slope,
      coalesce(n, 0) AS alerts, worst FROM fleet JOIN stats USING (device_id) LEFT JOIN
      (SELECT device_id, count(*) AS n, string_agg(rule_id, ',' ORDER BY rule_id) AS worst FROM fired GROUP BY 1)
      USING (device_id)""",
)
def fleet_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per device: newest snapshot time, week statistics and slope, and the alerts that fire."""
    series = T.events(spark, sf_dir).select("device_id", "ts", F.col("v").alias("value"))
    week = temporal.rolling_stats(series, window="7d")
    slope = rounded(temporal.linear_trend(series, window="7d"), 6)
    latest = merged(spark, sf_dir)
    fired = alerts.evaluate(latest).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("worst")
    )
    rows = latest.select("device_id", ts_text("ts").alias("ts"))
    return (
        rows.join(rounded(week), "device_id")
        .join(slope, "device_id")
        .join(fired, "device_id", "left")
        .withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    )


