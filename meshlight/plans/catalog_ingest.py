"""Queries over telemetry messages: topics, decoding, checks, features, raw-file imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.operators import features, imports, parse
from meshlight.plans.catalog import EV, query, rounded, ts_sql, ts_text
from meshlight.sources import tables as T

MSG = (
    f"msg AS (SELECT *, {T._KIND} AS kind FROM ev), "
    "typed AS (SELECT *, CASE WHEN kind = 'meta' AND k >= 95 THEN 'router' "
    f"ELSE '{V.TOPIC_ROOT}' END AS root FROM msg), "
    "judged AS (SELECT *, CASE WHEN root <> '" + V.TOPIC_ROOT + "' THEN 'bad_topic' "
    "WHEN event_type = 'error' AND k >= 97 THEN 'bad_json' WHEN kind = 'unknown' THEN 'unknown_type' "
    "WHEN kind = 'flowstatd/other' THEN 'unknown_subtopic' "
    "WHEN (kind = 'bbst' AND k >= 96) OR (kind = 'qoe' AND v > 100) OR (kind = 'events' AND k % 4 = 3) "
    "THEN 'failed_check' END AS reason, "
    "CASE WHEN kind LIKE 'flowstatd%' OR kind = 'wifi' THEN ts + INTERVAL 5 SECOND ELSE ts END AS seen_at, "
    "CASE kind WHEN 'flowstatd/stats' THEN 'flowstatd_stats' WHEN 'flowstatd/category_hours' "
    "THEN 'flowstatd_hours' ELSE kind END AS msg_type FROM typed)"
)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.decode(T.messages(spark, sf_dir))


@query(
    "topic_filter", EV, MSG,
    sql=f"SELECT root || '/' || kind AS route, count(*) AS messages FROM judged "
    f"WHERE root = '{V.TOPIC_ROOT}' AND kind <> 'unknown' GROUP BY 1",
)
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.subscribed(T.messages(spark, sf_dir))
    route = F.regexp_replace("topic", "/dev-[0-9]+/", "/")
    return rows.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("messages"))


@query(
    "topic_split", EV, MSG,
    sql=f"SELECT CASE WHEN root = '{V.TOPIC_ROOT}' THEN device_id END AS device_id, "
    f"CASE WHEN root = '{V.TOPIC_ROOT}' THEN split_part(kind, '/', 1) END AS msg_type, "
    f"CASE WHEN root = '{V.TOPIC_ROOT}' THEN split_part(kind, '/', 2) END AS subtopic, "
    "count(*) AS messages FROM judged GROUP BY 1, 2, 3",
)
def topic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.split_topic(T.messages(spark, sf_dir))
    return rows.groupBy("device_id", "msg_type", "subtopic").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "typed_payloads", EV, MSG,
    sql="SELECT msg_type, count(*) AS messages, round(sum(CASE msg_type WHEN 'bbst' THEN v * 10 WHEN 'qoe' THEN v "
    "WHEN 'wifi' THEN k % 6 WHEN 'classifi' THEN k % 5 WHEN 'flowstatd_stats' THEN k % 5 "
    "WHEN 'flowstatd_hours' THEN k % 4 ELSE 1 END), 4) AS content "
    "FROM judged WHERE reason IS NULL GROUP BY 1",
)
def typed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce(
        F.col("bbst.download.mbps"),
        F.col("qoe.compositeScore"),
        F.size("wifi.clients").cast("double"),
        F.size("classifi.flows").cast("double"),
        F.size("flowstatd_stats.categories").cast("double"),
        F.size("flowstatd_hours.hours").cast("double"),
        F.length(F.coalesce("events.deviceId", "meta.mac")) / F.length("device_id"),
    )
    return (
        parse.accepted(decoded(spark, sf_dir))
        .groupBy("msg_type")
        .agg(F.count(F.lit(1)).alias("messages"), F.round(F.sum(content), 4).alias("content"))
    )


@query(
    "quarantine", EV, MSG,
    sql="SELECT root || '/' || device_id || '/' || kind AS topic, "
    f"{ts_sql('ts + INTERVAL 5 SECOND')} AS received, reason FROM judged WHERE reason IS NOT NULL",
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = parse.quarantined(decoded(spark, sf_dir))
    return bad.select("topic", ts_text("ingest_ts").alias("received"), "reason")


@query(
    "ingest_counters", EV, MSG,
    sql="SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS messages FROM judged GROUP BY 1",
)
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.counters(decoded(spark, sf_dir))


# ---------------------------------------------------------------------------- feature extraction


def _features(spark: SparkSession, sf_dir: str, msg_type: str) -> DataFrame:
    rows = features.feature_columns(parse.decode(T.messages(spark, sf_dir)), msg_type)
    return rounded(rows.withColumn("ts", ts_text("ts")))


FEATURE_SQL: dict[str, str] = {}


def _feature_sql(msg_type: str, columns: dict[str, str], before: str = "") -> str:
    body = ", ".join(f"round(CAST({text} AS DOUBLE), 8) AS {name}" for name, text in columns.items())
    FEATURE_SQL[msg_type] = (
        f"SELECT device_id, {ts_sql('seen_at')} AS ts, {body} FROM (SELECT *{before} FROM judged "
        f"WHERE reason IS NULL AND msg_type = '{msg_type}')"
    )
    return FEATURE_SQL[msg_type]


@query(
    "speed_features", EV, MSG,
    sql=_feature_sql(
        "bbst",
        {
            "dl_mbps_latest": "v * 10",
            "ul_mbps_latest": "v",
            "dl_capacity_pct": "k",
            "ul_capacity_pct": "k",
            "dl_bloat_pct": "greatest((v / 4 - idle) / idle * 100, 0)",
            "ul_bloat_pct": "greatest((v / 8 - idle) / idle * 100, 0)",
            "latency_idle_ms": "k / 8",
            "latency_dl_ms": "v / 4",
            "latency_ul_ms": "v / 8",
            "jitter_idle_ms": "k / 64",
            "jitter_dl_ms": "v / 64",
            "bloat_grade_dl": "k % 4",
            "bloat_grade_ul": "0",
            "provisioned_dl_mbps": "500 + k",
            "provisioned_ul_mbps": "50",
            "test_duration_sec": "v / 2",
        },
        ", greatest(k / 8, CAST(0.1 AS DOUBLE)) AS idle",
    ),
)
def speed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "bbst")


@query(
    "qoe_features", EV, MSG,
    sql=_feature_sql(
        "qoe",
        {
            "qoe_composite_latest": "v",
            "qoe_wan_latest": "k",
            "qoe_wifi_latest": "k * 7 % 101",
            "qoe_mesh_latest": "k * 13 % 101",
            "qoe_system_latest": "75",
            "qoe_lan_latest": "99 - k",
            "qoe_worst_category": "list_position([k, k * 7 % 101, k * 13 % 101, 75, 99 - k], "
            "least(k, k * 7 % 101, k * 13 % 101, 75, 99 - k)) - 1",
            "qoe_impact_count": "2 * (k % 4 + 1)",
            "qoe_total_penalty": "2 * ((k % 4 + 1) * v / 8 + (k % 4 + 1) * (k % 4 + 2) / 2)",
            "qoe_satellite_count": "k % 3",
        },
    ),
)
def qoe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "qoe")


@query(
    "wifi_features", EV, MSG,
    sql=_feature_sql(
        "wifi",
        {
            "wifi_client_count": "n",
            "wifi_avg_rssi": "CASE WHEN n > 0 THEN -40 - k / 2 - (n - 1) / 2 ELSE 0 END",
            "wifi_min_rssi": "CASE WHEN n > 0 THEN -40 - k / 2 - (n - 1) ELSE 0 END",
            "wifi_avg_retransmit_rate": "CASE WHEN n > 0 THEN v / 16 + (n - 1) / 2 ELSE 0 END",
            "wifi_max_retransmit_rate": "CASE WHEN n > 0 THEN v / 16 + n - 1 ELSE 0 END",
            "wifi_pct_2_4ghz": "CASE WHEN n > 0 THEN len(list_filter(bands, lambda b: b = 0)) / n ELSE 0 END",
            "wifi_pct_5ghz": "CASE WHEN n > 0 THEN len(list_filter(bands, lambda b: b = 1)) / n ELSE 0 END",
            "wifi_pct_6ghz": "CASE WHEN n > 0 THEN len(list_filter(bands, lambda b: b = 2)) / n ELSE 0 END",
            "wifi_airtime_util_max": "k / 2 + 1",
            "wifi_interference_max": "k / 4 + 2.5",
            "mesh_satellite_count": "s",
            "mesh_satellite_offline_count": "CASE WHEN s = 2 THEN 1 ELSE 0 END",
            "mesh_backhaul_min_dl_mbps": "CASE WHEN s > 0 THEN v ELSE 0 END",
            "mesh_max_hops": "s",
        },
        ", k % 6 AS n, k % 3 AS s, list_transform(range(CAST(k % 6 AS INTEGER)), lambda i: (i + k) % 3) AS bands",
    ),
)
def wifi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "wifi")


def _share(code: int) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_filter(idx, lambda i: (i + k) % 4 = {code}), "
        "lambda i: k * 100 + i * 500)), 0) / greatest(total, 1)"
    )


@query(
    "traffic_features", EV, MSG,
    sql=_feature_sql(
        "flowstatd_stats",
        {
            "traffic_total_bytes_1h": "total",
            "traffic_flow_count_1h": "n * k + n * (n - 1) / 2",
            "traffic_max_risk_score": "coalesce(list_max(list_transform(idx, lambda i: (k * 3 + i) % 150)), 0)",
            "traffic_streaming_pct": _share(0),
            "traffic_gaming_pct": _share(1),
            "traffic_voip_pct": _share(2),
        },
        ", k % 5 AS n, range(CAST(k % 5 AS INTEGER)) AS idx, "
        "(k % 5) * k * 100 + 500 * (k % 5) * (k % 5 - 1) / 2 AS total",
    ),
)
def traffic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "flowstatd_stats")


@query(
    "flow_risk_features", EV, MSG,
    sql=_feature_sql(
        "classifi",
        {
            "traffic_high_risk_flow_count": "len(list_filter(risks, lambda r: r > 50))",
            "traffic_max_risk_score": "coalesce(list_max(risks), 0)",
        },
        ", list_transform(range(CAST(k % 5 AS INTEGER)), lambda i: (k + i * 17) % 100) AS risks",
    ),
)
def flow_risk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "classifi")


_INCREMENTS = {
    **{n: f"CASE WHEN k % 4 = {i} THEN 1 END" for i, n in enumerate(V.SEVERITY_INCREMENTS.values())},
    **{n: f"CASE WHEN k % 7 = {T.EVENT_KINDS.index(t)} THEN 1 END" for t, n in V.TYPE_INCREMENTS.items()},
}


@query("event_increments", EV, MSG, sql=_feature_sql("events", _INCREMENTS))
def event_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "events")


@query(
    "feature_snapshots", EV, MSG,
    sql=" UNION ALL ".join(
        f"SELECT device_id, ts, '{kind}' AS msg_type, feature, value FROM "
        f"(UNPIVOT ({text}) ON COLUMNS(* EXCLUDE (device_id, ts)) INTO NAME feature VALUE value)"
        for kind, text in FEATURE_SQL.items()
    ),
)
def feature_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every snapshot, one row each."""
    return feature_rows(features.snapshots(decoded(spark, sf_dir)))


def feature_rows(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("device_id", ts_text("ts").alias("ts"), "msg_type", F.explode("features").alias("feature", "value"))
    return rounded(rows)


@query(
    "hourly_usage", EV, MSG,
    sql="""SELECT device_id, ['Streaming','Gaming','VoIP','Web'][CAST((i + k) % 4 AS INTEGER) + 1] AS category,
      strftime(ts, '%Y-%m-%d %H') AS hour, sum(k * 10 + i) AS rx_bytes, sum(k) AS tx_bytes, sum(k / 2) AS active_sec
      FROM (SELECT *, unnest(range(CAST(k % 4 AS INTEGER))) AS i FROM judged
        WHERE reason IS NULL AND msg_type = 'flowstatd_hours') GROUP BY 1, 2, 3""",
)
def hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly_usage(decoded(spark, sf_dir))


# ----------------------------------------------------------------------------------- raw imports


@query(
    "speed_archive_import", EV,
    sql=f"""SELECT 'bbst-10.0.' || user_id AS device_id, {ts_sql("date_trunc('second', ts)")} AS ts,
      CASE WHEN k < 50 THEN 't' || event_id ELSE 'bbst-' || CAST(floor(epoch(ts)) AS BIGINT) END AS id,
      round(v * 3, 8) AS dl_mbps_latest, CASE WHEN k < 90 THEN k * 4 ELSE 0 END AS provisioned_dl_mbps,
      round(greatest((v / 4 - greatest(k / 8, CAST(0.1 AS DOUBLE))) / greatest(k / 8, CAST(0.1 AS DOUBLE)) * 100, 0), 8)
        AS dl_bloat_pct FROM ev""",
)
def speed_archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.events(spark, sf_dir).selectExpr(
        "if(k < 50, concat('t', event_id), null) AS test_id",
        "double(floor(unix_micros(ts) / 1000000)) AS starttime",
        "v / 2 AS runtime",
        "named_struct('mbps', v * 3, 'pct_utilization', k) AS download",
        "named_struct('mbps', v, 'pct_utilization', k) AS upload",
        "named_struct('idle_avg', k / 8, 'download_avg', v / 4, 'upload_avg', v / 8, 'idle_jitter', 0D, "
        "'download_jitter', 0D, 'upload_jitter', 0D) AS latency",
        "named_struct('ip', concat('10.0.', user_id)) AS client",
        "if(k < 90, named_struct('downstream_service_rate', k * 4, 'upstream_service_rate', k), null) AS test_options",
    )
    rows = imports.speed_archive(raw)
    wanted = features.speed(F.col("bbst"))
    picked = ("dl_mbps_latest", "provisioned_dl_mbps", "dl_bloat_pct")
    return rows.select(
        "device_id", ts_text("ts").alias("ts"), "bbst.id", *[F.round(wanted[n], 8).alias(n) for n in picked]
    )


@query(
    "wireless_status_import", EV,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, CAST(2 AS INTEGER) AS airtime,
      CAST(2 * (k % 4) AS INTEGER) AS clients, '2.4GHz,5GHz' AS bands,
      CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS BIGINT) AS first_channel,
      round(CAST(2 * (k % 4) * v / 10 AS DOUBLE), 8) AS rate FROM ev""",
)
def wireless_status_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = (
        "transform(filter(sequence(0, 3), i -> i < k % 4), i -> named_struct('mac', concat('m', i), 'signal', -50 - i, "
        "'rx', named_struct('rate', v * 100, 'mcs', 7, 'bytes', 10)))"
    )
    radios = (
        f"map('radio0', named_struct('config', named_struct('band', '2g', 'channel', if(k % 2 = 0, string(int(k)), 'auto')), "
        f"'interfaces', array(named_struct('assoclist', {stations}))), "
        f"'radio1', named_struct('config', named_struct('band', 'xx', 'channel', '36'), "
        f"'interfaces', array(named_struct('assoclist', {stations}))), "
        "'radio2', named_struct('config', null, 'interfaces', null))"
    )
    status = T.events(spark, sf_dir).selectExpr("device_id", "ts", f"to_json({radios}) AS status")
    rows = imports.wireless_payload(status)
    return rows.select(
        "device_id",
        ts_text("ts").alias("ts"),
        F.size("airtime").alias("airtime"),
        F.size("clients").alias("clients"),
        F.array_join("airtime.band", ",").alias("bands"),
        F.get("airtime.channel", F.lit(0)).alias("first_channel"),
        F.round(
            F.aggregate("clients", F.lit(0.0), lambda t, c: t + c["phyRateMbps"]), 8
        ).alias("rate"),
    )


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = (
        "transform(filter(sequence(0, 99), i -> i < k), i -> named_struct('mac', if(i % 7 = 0, '', "
        "concat('aa:', i)), 'name', concat('n', i), 'interface', element_at(array("
        "concat('w5gM.sta', i % 4), 'w6gS1.sta0', 'eth0', 'w2g.sta1'), i % 4 + 1), "
        "'rx_bytes', bigint(i * 100 + k), 'tx_bytes', bigint(i), 'rx_bps', v, 'tx_bps', v))"
    )
    return T.dealt(T.events(spark, sf_dir)).selectExpr("device_id", "ts", f"to_json(named_struct('devices', {listed})) AS flows")


POLL_ROWS = (
    "poll AS (SELECT *, unnest(range(CAST(k AS INTEGER))) AS i FROM ev)"
)


@query(
    "client_traffic_import", EV, POLL_ROWS,
    sql="""SELECT 'aa' || i AS device_id, count(*) AS messages, CAST(sum(i * 101 + k) AS DOUBLE) AS total_bytes
      FROM poll WHERE i % 7 <> 0 GROUP BY 1""",
)
def client_traffic_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imports.client_traffic(imports.flow_rows(_polls(spark, sf_dir)))
    total = features.traffic(F.col("flowstatd_stats"))["traffic_total_bytes_1h"]
    return rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(total).alias("total_bytes")
    )


@query(
    "mesh_satellites_import", EV, POLL_ROWS,
    sql=f"""SELECT device_id, {ts_sql('ts')} AS ts, CASE i % 4 WHEN 0 THEN 'w5gM' WHEN 1 THEN 'w6gS1' ELSE 'w2g' END
        AS satellite, count(*) AS connected_clients, CASE WHEN i % 4 = 1 THEN '6GHz' ELSE '5GHz' END AS backhaul_band,
      CAST(1 AS INTEGER) AS hops, 'online' AS status FROM poll WHERE i % 4 <> 2 GROUP BY device_id, ts, i % 4""",
)
def mesh_satellites_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = imports.mesh_clients(imports.flow_rows(_polls(spark, sf_dir)))
    return imports.mesh_satellites(clients).withColumn("ts", ts_text("ts"))


@query(
    "mesh_clients_import", EV, POLL_ROWS,
    sql="""SELECT CASE i % 4 WHEN 0 THEN '5GHz' WHEN 1 THEN '6GHz' ELSE '2.4GHz' END AS band,
      CAST(CASE WHEN i % 4 = 1 THEN 160 ELSE 80 END AS INTEGER) AS channel_width, count(*) AS clients,
      CAST(sum(i * 100 + k) AS BIGINT) AS rx_bytes FROM poll WHERE i % 4 <> 2 GROUP BY i % 4""",
)
def mesh_clients_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = imports.mesh_clients(imports.flow_rows(_polls(spark, sf_dir)))
    return clients.groupBy("band", "channel_width").agg(
        F.count(F.lit(1)).alias("clients"), F.sum("rx_bytes").alias("rx_bytes")
    )
