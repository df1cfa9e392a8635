"""The driver's tables seen as telemetry: messages, snapshots, events, heartbeats, series, labels.

Snapshot formulas are plain SQL over (event_type, v, k), the same text in Spark and in the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V

# The common "now" of all queries: the end of the event table's month.
AS_OF = "2024-01-31 00:00:00"
WEEK_START = "2024-01-24 00:00:00"

# feature -> (event type whose messages carry it, formula over value v and integer k)
SNAPSHOT_FORMULAS = {
    "dl_mbps_latest": ("view", "v * 60 / 7"),
    "ul_mbps_latest": ("view", "v * 13 / 7"),
    "dl_capacity_pct": ("view", "k + 0"),
    "dl_bloat_pct": ("view", "v * 30 / 7"),
    "latency_idle_ms": ("view", "k * 3 / 4"),
    "jitter_idle_ms": ("view", "v / 7"),
    "provisioned_dl_mbps": ("view", "500 + k * 5"),
    "qoe_composite_latest": ("signup", "least(v * 13 / 7, 100)"),
    "qoe_wan_latest": ("signup", "k + 0"),
    "qoe_wifi_latest": ("signup", "100 - k"),
    "qoe_mesh_latest": ("signup", "least(v + k, 100)"),
    "qoe_system_latest": ("signup", "75 + 0"),
    "qoe_worst_category": ("signup", "k % 5"),
    "wifi_client_count": ("click", "k % 25"),
    "wifi_avg_rssi": ("click", "0 - 30 - k / 2"),
    "wifi_avg_retransmit_rate": ("click", "v * 2 / 7"),
    "wifi_airtime_util_max": ("click", "k * 7 / 8"),
    "wifi_pct_2_4ghz": ("click", "k / 128"),
    "mesh_satellite_count": ("click", "k % 4"),
    "mesh_backhaul_min_dl_mbps": ("click", "v * 25 / 7"),
    "traffic_max_risk_score": ("purchase", "k * 3 / 2"),
    "traffic_total_bytes_1h": ("purchase", "v * 7000 / 3"),
    "traffic_streaming_pct": ("purchase", "k / 128"),
}
SNAPSHOT_FEATURES = list(SNAPSHOT_FORMULAS)

# Event kinds by k modulo 7.
EVENT_KINDS = [
    "connection_lost",
    "bloat_exceeds_threshold",
    "security_risk_detected",
    "high_packet_loss",
    "qoe_score_drop",
    "firmware_version_changed",
    "custom_note",
]


def formula(feature: str) -> str:
    """SQL text of one snapshot feature; ``k`` must be a double."""
    kind, text = SNAPSHOT_FORMULAS[feature]
    return f"CASE WHEN event_type = '{kind}' THEN CAST({text} AS DOUBLE) END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [f.name for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, device_id, user_id, event_type, v, k) of the event table."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        "user_id",
        "event_type",
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature snapshots as real columns; each row holds the features of one message type."""
    return events(spark, sf_dir).select(
        "device_id", "ts", *[F.expr(formula(f)).alias(f) for f in SNAPSHOT_FEATURES]
    )


def snapshot_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots with the features in a map, as stored."""
    pairs = [x for f in SNAPSHOT_FEATURES for x in (F.lit(f), F.col(f))]
    full = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return snapshots(spark, sf_dir).select("device_id", "ts", full.alias("features"))


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a severity by event type and a kind by k."""
    kinds = F.array(*[F.lit(k) for k in EVENT_KINDS])
    severity = (
        F.when(F.col("event_type") == "error", "critical")
        .when(F.col("event_type") == "signup", "warning")
        .otherwise("info")
    )
    return events(spark, sf_dir).select(
        "event_id",
        "device_id",
        "ts",
        severity.alias("severity"),
        F.element_at(kinds, (F.col("k") % 7 + 1).cast("int")).alias("type"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats: model by device, firmware by week, subscriber from the customer table."""
    rows = events(spark, sf_dir).select(
        "device_id",
        "ts",
        F.format_string("M-%02d", F.col("user_id") % 12).alias("model"),
        F.format_string("fw-%02d", F.floor(F.dayofmonth("ts") / F.lit(7))).alias("firmware"),
        F.floor(F.col("user_id") / F.lit(2)).alias("c_custkey"),
    )
    owners = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("subscriber_id"))
    return rows.join(owners.hint("merge"), "c_custkey", "left").drop("c_custkey")  # a row a customer: not for the driver


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long numeric series per device (device_id, ts, value): one per user, one per event type."""
    rows = events(spark, sf_dir)
    typed = rows.select(F.concat(F.lit("type-"), "event_type").alias("device_id"), "ts", F.col("v").alias("value"))
    return rows.select("device_id", "ts", F.col("v").alias("value")).unionByName(typed)


# ---------------------------------------------------------------------------------- messages


def _payload_sql() -> str:
    """Spark SQL for the JSON payload of the message an event becomes.

    All eight payload types occur, as do broken JSON, unknown types and subtopics, values out of
    range and foreign topics.
    """
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    category = (
        "named_struct('name', '{n}', 'score', {s}, 'grade', 'B', 'weight', 0.2D, 'impactFactors', {i})"
    )
    impacts = (
        f"transform(sequence(1, int(k % 4) + 1), i -> named_struct('name', 'f', 'subject', 's', 'detail', 'd', "
        f"'penalty', v / 8 + i, 'severity', 'minor', 'timestamp', {stamp}))"
    )
    empty = f"filter({impacts}, x -> false)"
    scores = {"wan": "k", "wifi": "k * 7 % 101", "mesh": "k * 13 % 101", "system": "75D", "lan": "99 - k"}
    categories = ", ".join(
        f"'{n}', " + category.format(n=n, s=s, i=impacts if n in ("wifi", "lan") else empty)
        for n, s in scores.items()
    )

    def side(rate: str, grade: str, provisioned: str) -> str:
        return (
            f"named_struct('mbps', {rate}, 'capacityPercent', k, 'bloatPercent', 5D, "
            f"'bloatGrade', {grade}, 'provisionedMbps', {provisioned})"
        )

    grade = "if(k >= 96, 'Z', element_at(array('A','B','C','D'), int(k % 4) + 1))"
    bands = "element_at(array('2.4GHz','5GHz','6GHz'), int((i + k) % 3) + 1)"
    kinds = ", ".join(f"'{k}'" for k in EVENT_KINDS)

    def items(count: str, struct: str) -> str:
        return f"filter(transform(sequence(0, int({count})), i -> {struct}), x -> x.i < {count})"

    payloads = {
        "bbst": (
            f"named_struct('id', mid, 'deviceId', device_id, 'timestamp', {stamp}, "
            f"'download', {side('v * 10', grade, '500 + k')}, 'upload', {side('v', repr('A'), '50D')}, "
            "'latency', named_struct('idleMs', k / 8, 'downloadMs', v / 4, 'uploadMs', v / 8, "
            "'idleJitterMs', k / 64, 'downloadJitterMs', v / 64), 'durationSec', v / 2)"
        ),
        "qoe": (
            f"named_struct('id', mid, 'deviceId', device_id, 'timestamp', {stamp}, 'compositeScore', v, "
            f"'compositeGrade', 'C', 'categories', named_struct({categories}), 'satelliteCount', int(k % 3))"
        ),
        "wifi": (
            "named_struct('clients', "
            + items(
                "k % 6",
                f"named_struct('i', i, 'mac', concat('c', i), 'band', {bands}, 'channel', i + 1, "
                "'rssi', 0 - 40 - i - k / 2, 'retransmissionRate', v / 16 + i)",
            )
            + ", 'satellites', "
            + items(
                "k % 3",
                "named_struct('i', i, 'id', concat('s', i), 'mac', 'm', 'backhaulDlMbps', v * (i + 1), "
                "'hops', i + 1, 'status', if(i = 1, 'offline', 'online'))",
            )
            + ", 'airtime', "
            + items(
                "2",
                "named_struct('i', i, 'band', '5GHz', 'channel', 36, 'wifiInterferencePercent', k / 4 + i, "
                "'nonWifiInterferencePercent', 1.5D, 'totalUtilizationPercent', k / 2 + i)",
            )
            + ")"
        ),
        "classifi": (
            "named_struct('flows', "
            + items(
                "k % 5",
                "named_struct('i', i, 'id', concat('f', i), 'deviceId', device_id, 'srcIp', 'a', 'srcPort', 1, "
                "'dstIp', 'b', 'dstPort', 443, 'protocol', 'TCP', 'riskScore', int((k + i * 17) % 100))",
            )
            + f", 'timestamp', {stamp})"
        ),
        "meta": (
            "named_struct('mac', device_id, 'model', concat('M-', int(k % 5)), 'firmware', concat('fw-', int(k % 3)), "
            f"'status', 'online', 'timestamp', {stamp}, 'subscriberId', concat('sub-', user_id))"
        ),
        "flowstatd/stats": (
            "named_struct('device_mac', device_id, 'categories', "
            + items(
                "k % 5",
                "named_struct('i', i, 'masterProtocol', 'IP', 'appProtocol', 'x', 'category', "
                "element_at(array('Streaming','Gaming','VoIP','Web'), int((i + k) % 4) + 1), "
                "'totalBytes', bigint(k * 100 + i * 500), 'flowCount', int(k + i), 'maxRiskScore', int((k * 3 + i) % 150))",
            )
            + ")"
        ),
        "flowstatd/category_hours": (
            "named_struct('device_mac', device_id, 'hours', "
            + items(
                "k % 4",
                "named_struct('i', i, 'deviceId', device_id, 'mac', 'm', 'masterProtocol', 'IP', 'appProtocol', 'x', "
                "'category', element_at(array('Streaming','Gaming','VoIP','Web'), int((i + k) % 4) + 1), "
                "'hour', date_format(ts, 'yyyy-MM-dd HH'), 'rxBytes', bigint(k * 10 + i), 'txBytes', bigint(k), "
                "'activeTimeSec', k / 2)",
            )
            + ")"
        ),
        "events": (
            f"named_struct('id', mid, 'deviceId', device_id, 'type', element_at(array({kinds}), int(k % 7) + 1), "
            f"'severity', element_at(array('critical','warning','info','fatal'), int(k % 4) + 1), 'timestamp', {stamp})"
        ),
    }
    cases = " ".join(f"WHEN kind = '{kind}' THEN to_json({text})" for kind, text in payloads.items())
    return (
        f"CASE WHEN event_type = 'error' AND k >= 97 THEN 'not json' {cases} "
        """ELSE '{"key":"value"}' END"""
    )


_KIND = """
  CASE event_type
    WHEN 'view' THEN 'bbst' WHEN 'signup' THEN 'qoe'
    WHEN 'click' THEN CASE WHEN k < 50 THEN 'wifi' WHEN k < 80 THEN 'classifi' ELSE 'meta' END
    WHEN 'purchase' THEN CASE WHEN k < 60 THEN 'flowstatd/stats'
      WHEN k < 90 THEN 'flowstatd/category_hours' ELSE 'flowstatd/other' END
    ELSE CASE WHEN k IN (95, 96) THEN 'unknown' ELSE 'events' END
  END"""


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt anew over all cores, some tasks each.

    For rows that messages are made of: a message costs a hundred times the reading of its row, and files are
    split by the size of compressed rows, so that a few tasks would make and decode all messages.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the event table as a telemetry message."""
    rows = dealt(events(spark, sf_dir)).withColumns(
        {"mid": F.concat(F.lit("m"), "event_id"), "kind": F.expr(_KIND)}
    )
    root = F.when((F.col("kind") == "meta") & (F.col("k") >= 95), "router").otherwise(V.TOPIC_ROOT)
    return rows.select(
        F.concat_ws("/", root, "device_id", "kind").alias("topic"),
        F.expr(_payload_sql()).alias("payload"),
        (F.col("ts") + F.expr("interval 5 seconds")).alias("ingest_ts"),
    )
