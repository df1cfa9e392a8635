"""Queries over snapshots, series, events and devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.operators import counters, store, temporal
from meshlight.plans.catalog import (
    AS_OF,
    DEVICE_EVENTS,
    EV,
    FLEET,
    HEARTBEATS,
    SERIES,
    SNAP,
    query,
    rounded,
    ts_sql,
    ts_text,
)
from meshlight.sources import tables as T

SPEED_TRIO = ["dl_mbps_latest", "latency_idle_ms", "dl_bloat_pct"]
PROBE = "dev-8"


@query(
    "device_history", EV, SNAP,
    sql=f"""SELECT {ts_sql('ts')} AS ts, {', '.join(SPEED_TRIO)} FROM snap WHERE device_id = '{PROBE}'
      AND ts BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}""",
)
def device_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.history(T.snapshots(spark, sf_dir), PROBE, T.AS_OF)
    return rows.select(ts_text("ts").alias("ts"), *SPEED_TRIO)


@query(
    "features_as_columns", EV, SNAP,
    sql=f"SELECT device_id, {ts_sql('ts')} AS ts, {', '.join(SPEED_TRIO)} FROM snap",
)
def features_as_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.as_columns(T.snapshot_maps(spark, sf_dir), SPEED_TRIO)
    return rows.withColumn("ts", ts_text("ts"))


@query(
    "device_latest", EV, SNAP,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, {', '.join(SPEED_TRIO)} FROM snap
      WHERE device_id = '{PROBE}' ORDER BY snap.ts DESC LIMIT 1""",
)
def device_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.latest_of(T.snapshot_maps(spark, sf_dir), PROBE)
    return store.as_columns(rows, SPEED_TRIO).withColumn("ts", ts_text("ts"))


_NEWEST = "newest AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC) = 1)"
_ALL = ", ".join(T.SNAPSHOT_FEATURES)


@query(
    "fleet_latest", EV, SNAP, _NEWEST, sql=f"SELECT device_id, {ts_sql('ts')} AS ts, {_ALL} FROM newest"
)
def fleet_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.fleet_latest(T.snapshots(spark, sf_dir), T.SNAPSHOT_FEATURES)
    return rows.withColumn("ts", ts_text("ts"))


@query(
    "fleet_latest_of_list", EV, SNAP, _NEWEST,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, {_ALL} FROM newest WHERE device_id IN
      (SELECT 'dev-' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def fleet_latest_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = T.read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    listed = customers.select(F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"))
    rows = store.fleet_latest(T.snapshots(spark, sf_dir), T.SNAPSHOT_FEATURES, device_ids=listed)
    return rows.withColumn("ts", ts_text("ts"))


@query(
    "feature_projection", EV, SNAP,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, CAST((dl_mbps_latest IS NOT NULL)::INTEGER * 2 AS INTEGER) AS kept,
      dl_mbps_latest FROM snap""",
)
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.only(T.snapshot_maps(spark, sf_dir), ["dl_mbps_latest", "dl_bloat_pct"])
    return rows.select(
        "device_id",
        ts_text("ts").alias("ts"),
        F.size("features").alias("kept"),
        F.try_element_at("features", F.lit("dl_mbps_latest")).alias("dl_mbps_latest"),
    )


@query(
    "fleet_capped", EV, SNAP, _NEWEST,
    sql=f"SELECT device_id, {ts_sql('ts')} AS ts FROM newest ORDER BY device_id LIMIT 5",
)
def fleet_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.fleet_latest(T.snapshots(spark, sf_dir), ["dl_mbps_latest"], limit=5)
    return rows.select("device_id", ts_text("ts").alias("ts"))


@query(
    "fleet_merged", EV, SNAP, FLEET, sql=f"SELECT device_id, {ts_sql('ts')} AS ts, {_ALL} FROM fleet"
)
def fleet_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.fleet_merged(T.snapshots(spark, sf_dir), T.SNAPSHOT_FEATURES)
    return rows.withColumn("ts", ts_text("ts"))


@query(
    "orders_page",
    sql="""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total
      FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = T.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return store.page(pending, [F.desc("o_totalprice"), F.col("o_orderkey")], limit=50, offset=100)


# --------------------------------------------------------------------------------------- temporal

_LAST = "last AS (SELECT device_id, max(ts) AS last_ts FROM series GROUP BY 1)"


def _window(interval: str, name: str = "win") -> str:
    return (
        f"{name} AS (SELECT s.device_id, s.ts, s.value, l.last_ts FROM series s JOIN last l USING (device_id) "
        f"WHERE s.ts > l.last_ts - INTERVAL {interval})"
    )


_DAYS = "(epoch_us(ts) - epoch_us(last_ts)) / 86400000000.0"


@query(
    "rolling_stats", EV, SERIES, _LAST, _window("7 DAY"),
    sql="""SELECT device_id, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS std,
      min(value) AS min, max(value) AS max, count(*) AS count FROM win GROUP BY 1""",
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.rolling_stats(T.series(spark, sf_dir), window="7d"))


@query(
    "rolling_rows", EV, SERIES,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, value, round(avg(value) OVER w, 8) AS mean,
      round(coalesce(stddev_samp(value) OVER w, 0), 6) AS std, min(value) OVER w AS min, max(value) OVER w AS max,
      count(*) OVER w AS count FROM series WINDOW w AS (PARTITION BY device_id ORDER BY ts
      RANGE BETWEEN INTERVAL '{24 * 3600 * 10**6 - 1} microseconds' PRECEDING AND CURRENT ROW)""",
)
def rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the last 24 hours at every reading."""
    rows = temporal.rolling_rows(T.series(spark, sf_dir)).withColumn("ts", ts_text("ts"))
    return rows.withColumns({"mean": F.round("mean", 8), "std": F.round("std", 6)})


@query(
    "linear_trend", EV, SERIES, _LAST, _window("7 DAY"),
    sql=f"SELECT device_id, CASE WHEN count(*) > 1 THEN round(regr_slope(value, {_DAYS}), 6) ELSE 0 END AS slope FROM win GROUP BY 1",
)
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.linear_trend(T.series(spark, sf_dir), window="7d"), 6)


@query(
    "fraction_below", EV, SERIES,
    sql="""SELECT device_id, round(avg(CASE WHEN value < 40 THEN 1.0 ELSE 0.0 END), 8) AS fraction_below
      FROM series GROUP BY 1""",
)
def fraction_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.fraction_below(T.series(spark, sf_dir), 40.0))


@query(
    "drop_counts", EV, SERIES,
    sql="""SELECT device_id, CAST(count(*) FILTER (WHERE value - previous < -10) AS BIGINT) AS drops FROM
      (SELECT device_id, value, lag(value) OVER (PARTITION BY device_id ORDER BY ts) AS previous FROM series)
      GROUP BY 1""",
)
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.count_drops(T.series(spark, sf_dir))


BUNDLED = {"qoe_composite_latest": "qoe_composite", "dl_mbps_latest": "dl_mbps"}


def bundle_sql(source: dict[str, str], everyone: str) -> str:
    """Trailing statistics of the bundled features; ``source`` is where each one's readings (device_id, ts) come from."""
    parts = []
    for f, stem in BUNDLED.items():
        columns = []
        for w, interval in (("24h", "24 HOUR"), ("7d", "7 DAY")):
            inside = f"FILTER (WHERE ts > last_ts - INTERVAL {interval})"
            columns += [
                f"round(avg({f}) {inside}, 8) AS {stem}_mean_{w}",
                f"round(coalesce(stddev_samp({f}) {inside}, 0), 8) AS {stem}_std_{w}",
                f"round(min({f}) {inside}, 8) AS {stem}_min_{w}",
            ]
        week = "FILTER (WHERE ts > last_ts - INTERVAL 7 DAY)"
        slope = f"CASE WHEN count(*) {week} > 1 THEN regr_slope({f}, {_DAYS}) {week} ELSE 0 END"
        columns.append(f"CASE WHEN count(*) >= 2 THEN round({slope}, 6) END AS {stem}_trend_7d")
        parts.append(
            f"(SELECT device_id, {', '.join(columns)} FROM (SELECT device_id, ts, {f}, "
            f"max(ts) OVER (PARTITION BY device_id) AS last_ts FROM {source[f]} WHERE {f} IS NOT NULL) GROUP BY 1) AS {stem}"
        )
    return f"SELECT * FROM ({everyone}) AS everyone " + " ".join(f"LEFT JOIN {p} USING (device_id)" for p in parts)


@query(
    "temporal_bundle", EV, SNAP, sql=bundle_sql(dict.fromkeys(BUNDLED, "snap"), "SELECT DISTINCT device_id FROM snap")
)
def temporal_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_rows(temporal.bundle(T.snapshots(spark, sf_dir), list(BUNDLED), names=BUNDLED))


def bundle_rows(rows: DataFrame) -> DataFrame:
    trends = [c for c in rows.columns if c.endswith("_trend_7d")]
    return rounded(rounded(rows, 8, *trends), 6, *[c for c in rows.columns if c not in trends])


def _since(days: int) -> str:
    return f"ts > {AS_OF} - INTERVAL {days} DAY AND ts <= {AS_OF}"


COUNTER_SQL = f"""SELECT device_id,
  count(*) FILTER (WHERE severity = 'critical' AND {_since(1)}) AS events_critical_24h,
  count(*) FILTER (WHERE severity = 'warning' AND {_since(1)}) AS events_warning_24h,
  count(*) FILTER (WHERE {_since(7)}) AS events_total_7d,
  count(*) FILTER (WHERE type = 'connection_lost' AND {_since(7)}) AS events_connection_lost_7d,
  count(*) FILTER (WHERE type = 'bloat_exceeds_threshold' AND {_since(7)}) AS events_bloat_threshold_7d,
  count(*) FILTER (WHERE type = 'security_risk_detected' AND {_since(7)}) AS events_security_risk_7d,
  count(*) AS events_total_30d FROM dev_events WHERE {_since(30)} GROUP BY 1"""


@query("event_counters", EV, DEVICE_EVENTS, sql=COUNTER_SQL)
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.event_counters(T.device_events(spark, sf_dir), T.AS_OF)


@query(
    "qoe_history", EV, SNAP,
    "q AS (SELECT device_id, ts, qoe_composite_latest AS value, max(ts) OVER (PARTITION BY device_id) AS last_ts "
    "FROM snap WHERE qoe_composite_latest IS NOT NULL)",
    sql="""SELECT device_id, drops AS qoe_drops_24h, below AS qoe_below_70_pct_7d FROM
      (SELECT device_id, CAST(count(*) FILTER (WHERE value - previous < -10) AS BIGINT) AS drops FROM (SELECT device_id,
        value, lag(value) OVER (PARTITION BY device_id ORDER BY ts) AS previous FROM q
        WHERE ts > last_ts - INTERVAL 24 HOUR) GROUP BY 1)
      FULL JOIN (SELECT device_id, round(avg(CASE WHEN value < 70 THEN 1.0 ELSE 0.0 END), 8) AS below FROM q
        WHERE ts > last_ts - INTERVAL 7 DAY GROUP BY 1) USING (device_id)""",
)
def qoe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(counters.qoe_history(T.snapshots(spark, sf_dir)))


@query(
    "subscriber_rollup", EV, SNAP, HEARTBEATS, DEVICE_EVENTS,
    "owners AS (SELECT device_id, arg_max(subscriber_id, ts) AS subscriber_id, min(ts) AS first_seen FROM beats "
    "WHERE subscriber_id IS NOT NULL GROUP BY 1)",
    "quality AS (SELECT device_id, sum(qoe_composite_latest) AS s, count(qoe_composite_latest) AS n, "
    f"min(qoe_composite_latest) AS lowest FROM snap WHERE {_since(7)} AND qoe_composite_latest IS NOT NULL GROUP BY 1)",
    f"counts AS (SELECT device_id, count(*) AS n FROM dev_events WHERE {_since(30)} GROUP BY 1)",
    "tests AS (SELECT device_id, count(*) AS n, arg_max(dl_mbps_latest / provisioned_dl_mbps, ts) AS ratio FROM snap "
    f"WHERE {_since(30)} AND dl_mbps_latest IS NOT NULL GROUP BY 1)",
    sql=f"""SELECT subscriber_id, count(*) AS subscriber_device_count,
      round(sum(q.s) / sum(q.n), 8) AS subscriber_avg_qoe_7d, round(min(q.lowest), 8) AS subscriber_min_qoe_7d,
      CAST(coalesce(sum(c.n), 0) AS BIGINT) AS subscriber_total_events_30d,
      round(CAST(coalesce(sum(t.n), 0) AS DOUBLE) * 7 / 30.0, 8) AS subscriber_speed_test_frequency,
      CAST(date_diff('day', min(first_seen), {AS_OF}) AS INTEGER) AS subscriber_tenure_days,
      round(avg(ratio), 8) AS subscriber_dl_utilization_ratio
      FROM owners LEFT JOIN quality q USING (device_id) LEFT JOIN counts c USING (device_id)
      LEFT JOIN tests t USING (device_id) GROUP BY 1""",
)
def subscriber_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = T.snapshots(spark, sf_dir)
    return rounded(
        counters.subscriber_rollup(
            T.heartbeats(spark, sf_dir),
            snap.where("qoe_composite_latest IS NOT NULL").select(
                "device_id", "ts", F.col("qoe_composite_latest").alias("value")
            ),
            T.device_events(spark, sf_dir),
            snap.where("dl_mbps_latest IS NOT NULL").select(
                "device_id", "ts", F.col("dl_mbps_latest").alias("dl"), F.col("provisioned_dl_mbps").alias("provisioned")
            ),
            T.AS_OF,
        )
    )


@query(
    "device_metadata", EV, HEARTBEATS,
    "seen AS (SELECT device_id, arg_max(model, ts) AS model, arg_max(firmware, ts) AS firmware, min(ts) AS first "
    "FROM beats GROUP BY 1)",
    "fw AS (SELECT device_id, firmware, min(ts) AS first FROM beats GROUP BY 1, 2)",
    "models AS (SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS DOUBLE) AS code "
    "FROM (SELECT DISTINCT model FROM beats))",
    "firmwares AS (SELECT firmware, CAST(row_number() OVER (ORDER BY firmware) - 1 AS DOUBLE) AS code "
    "FROM (SELECT DISTINCT firmware FROM beats))",
    sql=f"""SELECT s.device_id, s.model, s.firmware, m.code AS model_encoded, f.code AS firmware_encoded,
      CAST(date_diff('day', fw.first, {AS_OF}) AS DOUBLE) AS firmware_age_days,
      CAST(date_diff('day', s.first, {AS_OF}) AS DOUBLE) AS device_age_days
      FROM seen s JOIN fw USING (device_id, firmware) JOIN models m USING (model) JOIN firmwares f USING (firmware)""",
)
def device_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.device_metadata(T.heartbeats(spark, sf_dir), T.AS_OF)
