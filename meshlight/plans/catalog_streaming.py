"""Streaming queries: each runs its stream over all waiting input and returns the written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.barrier import settled
from meshlight.operators import alerts, partials, store, temporal
from meshlight.plans.catalog import DEVICE_EVENTS, EV, ORACLES, SNAP, query, ts_sql, ts_text
from meshlight.plans.catalog_ingest import FEATURE_SQL, MSG, feature_rows
from meshlight.plans.catalog_rules import RULES
from meshlight.plans.catalog_store import BUNDLED, bundle_rows, bundle_sql
from meshlight.session import work_path, written
from meshlight.sources import messages
from meshlight.sources import tables as T
from meshlight.streaming.cooldown import triggered_runs
from meshlight.streaming.counters import windowed_counters
from meshlight.streaming.ingest import ingested, start_ingest


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream with the columns of T.events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), "event_type",
        F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over all waiting input into a table and read it."""
    out = work_path(spark, name)
    running = (
        stream.writeStream.format("parquet").option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    out = work_path(spark, "ingest")
    messages.write_messages(T.messages(spark, sf_dir), f"{out}/incoming")
    start_ingest(messages.stream_messages(spark, f"{out}/incoming"), out, f"{out}/state").awaitTermination()
    return out


@query("stream_ingest", sql=ORACLES["feature_snapshots"])
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(ingested(spark, _ingested(spark, sf_dir), "snapshots"))


@query(
    "stream_heartbeats", EV, MSG,
    sql=f"""SELECT device_id, {ts_sql('seen_at')} AS ts, 'M-' || CAST(k % 5 AS INTEGER) AS model, 'fw-' || CAST(k % 3 AS INTEGER)
      AS firmware, 'online' AS status, 'sub-' || user_id AS subscriber_id FROM judged WHERE reason IS NULL AND msg_type = 'meta'""",
)
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, _ingested(spark, sf_dir), "heartbeats").withColumn("ts", ts_text("ts"))


@query(
    "stream_events", EV, MSG,
    sql=f"""SELECT device_id, {ts_sql('seen_at')} AS ts, 'm' || event_id AS id, [{", ".join(f"'{k}'" for k in T.EVENT_KINDS)}]
      [CAST(k % 7 AS INTEGER) + 1] AS type, ['critical', 'warning', 'info', 'fatal'][CAST(k % 4 AS INTEGER) + 1] AS severity
      FROM judged WHERE reason IS NULL AND msg_type = 'events'""",
)
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, _ingested(spark, sf_dir), "events").withColumn("ts", ts_text("ts"))


@query("stream_hourly_usage", sql=ORACLES["hourly_usage"])
def stream_hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, _ingested(spark, sf_dir), "usage")


def _sent_again(sent: DataFrame) -> DataFrame:
    """The messages with the copies of those that carry an id or timestamp; each message is made once."""
    told = F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.timestamp")).isNotNull()
    once, again = F.col("ingest_ts"), F.col("ingest_ts") + F.expr("interval 1 second")
    times = F.when(told, F.array(once, again)).otherwise(F.array(once))
    return settled(sent).select("topic", "payload", F.explode(times).alias("ingest_ts"))


@query(
    "stream_redelivered", EV, MSG,
    sql=f"""SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS messages FROM judged
      WHERE root = '{V.TOPIC_ROOT}' AND kind <> 'unknown' GROUP BY 1""",
)
def stream_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with an id or timestamp comes twice, the copy a second later; counters of a stream that drops copies."""
    out = work_path(spark, "redelivered")
    messages.write_messages(_sent_again(T.messages(spark, sf_dir)), f"{out}/incoming")
    stream = messages.stream_messages(spark, f"{out}/incoming")
    start_ingest(stream, out, f"{out}/state", redelivered_within="1 hour").awaitTermination()
    return ingested(spark, out, "counters")


_READ = {
    f: f"(SELECT device_id, CAST(ts AS TIMESTAMP) AS ts, {f} FROM ({FEATURE_SQL[kind]}))"
    for f, kind in (("qoe_composite_latest", "qoe"), ("dl_mbps_latest", "bbst"))
}


@query(
    "stream_trends", EV, MSG,
    sql=bundle_sql(_READ, " UNION ".join(f"SELECT device_id FROM {read}" for read in _READ.values())),
)
def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing statistics from the hourly states that ingest keeps up; readings only where a window starts."""
    out = _ingested(spark, sf_dir)
    held = written(partials.side_by_side(ingested(spark, out, "hourly"), list(BUNDLED)), "hourly")
    snapshots = store.as_columns(ingested(spark, out, "snapshots"), list(BUNDLED))
    return bundle_rows(temporal.bundle(snapshots, list(BUNDLED), names=BUNDLED, held=held))


# Foreign topics are no subscription and never reach the quarantine of the stream.
@query("stream_quarantine", sql=f"SELECT * FROM ({ORACLES['quarantine']}) WHERE reason NOT IN ('bad_topic', 'unknown_type')")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_ingested(spark, sf_dir)}/quarantine")
    return rows.select("topic", ts_text("ingest_ts").alias("received"), "reason")


@query(
    "stream_event_counters", EV, DEVICE_EVENTS,
    sql=f"""SELECT device_id, {ts_sql("date_trunc('day', ts)")} AS start, count(*) FILTER (WHERE severity = 'critical') AS critical,
      count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE type = 'connection_lost') AS connection_lost,
      count(*) AS total FROM dev_events GROUP BY device_id, date_trunc('day', ts)
      HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in T.EVENT_KINDS])
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "warning")
    rows = _events_stream(spark, sf_dir).select(
        "device_id", "ts", severity.otherwise("info").alias("severity"),
        F.element_at(kinds, (F.col("k") % 7 + 1).cast("int")).alias("type"),
    )
    found = _drained(windowed_counters(rows), spark, "counters")
    return found.select("device_id", ts_text("start").alias("start"), "critical", "warning", "connection_lost", "total")


@query(
    "stream_alerts", EV, SNAP, RULES,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, rule_id, severity FROM (SELECT device_id, ts, unnest(['qoe_composite_latest',
      'dl_bloat_pct', 'latency_idle_ms', 'wifi_avg_retransmit_rate', 'traffic_max_risk_score']) AS feature,
      unnest([qoe_composite_latest, dl_bloat_pct, latency_idle_ms, wifi_avg_retransmit_rate, traffic_max_risk_score]) AS value
      FROM snap) JOIN rules USING (feature) WHERE CASE op WHEN 'gt' THEN value > threshold ELSE value < threshold END""",
)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events_stream(spark, sf_dir)
    measured = rows.select("device_id", "ts", *[F.expr(T.formula(f)).alias(f) for f in T.SNAPSHOT_FEATURES])
    found = _drained(alerts.evaluate(measured, keep=("device_id", "ts")), spark, "alerts")
    return found.select("device_id", ts_text("ts").alias("ts"), "rule_id", "severity")


_WALK = (
    "walk AS (SELECT device_id, ts, i, ts AS last, true AS starts FROM over WHERE i = 1 UNION ALL "
    f"SELECT o.device_id, o.ts, o.i, CASE WHEN o.ts - w.last >= INTERVAL {V.AGENT_COOLDOWN_HOURS} HOUR THEN o.ts ELSE w.last END, "
    f"o.ts - w.last >= INTERVAL {V.AGENT_COOLDOWN_HOURS} HOUR FROM walk w JOIN over o ON o.device_id = w.device_id AND o.i = w.i + 1)"
)
@query(
    "stream_cooldown", "RECURSIVE " + EV,
    f"over AS (SELECT device_id, ts, row_number() OVER (PARTITION BY device_id ORDER BY ts) AS i FROM ev WHERE v / 100 >= {V.AGENT_THRESHOLD})",
    _WALK,
    sql=f"SELECT device_id, {ts_sql('ts')} AS ts FROM walk WHERE starts",
)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _events_stream(spark, sf_dir).select("device_id", "ts", (F.col("v") / 100).alias("anomaly_score"))
    found = _drained(triggered_runs(scores), spark, "cooldown")
    return found.select("device_id", ts_text("ts").alias("ts"))
