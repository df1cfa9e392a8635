"""Topics, decoding, checks and feature extraction on hand-written messages."""

import json

import pytest
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.operators import features, imports, parse
from meshlight.sources import messages
from meshlight.sources.schemas import MESSAGE
from meshlight.streaming.ingest import start_ingest

ROOT = V.TOPIC_ROOT
CATEGORY = {"wan": (80, "B", 0.25), "wifi": (70, "C", 0.25), "mesh": (85, "B", 0.25), "system": (75, "B", 0.15), "lan": (90, "A", 0.10)}
QOE = {
    "id": "q1", "deviceId": "dev-123", "timestamp": "2026-04-01T12:00:00Z", "compositeScore": 78, "compositeGrade": "B",
    "categories": {n: {"name": n, "score": s, "grade": g, "weight": w, "impactFactors": []} for n, (s, g, w) in CATEGORY.items()},
}
SPEED = {
    "id": "s1", "deviceId": "d", "timestamp": "2026-04-01T12:00:00Z",
    "download": {"mbps": 500, "capacityPercent": 85, "bloatPercent": 30, "bloatGrade": "B", "provisionedMbps": 600},
    "upload": {"mbps": 100, "capacityPercent": 90, "bloatPercent": 10, "bloatGrade": "A", "provisionedMbps": 110},
    "latency": {"idleMs": 5, "downloadMs": 15, "uploadMs": 8, "idleJitterMs": 1, "downloadJitterMs": 3, "uploadJitterMs": 1.5},
}


def decoded(spark, *rows):
    """Rows are (topic below the root, payload as dict or text)."""
    data = [(f"{ROOT}/{t}", p if isinstance(p, str) else json.dumps(p), "2026-04-01 12:00:05") for t, p in rows]
    frame = spark.createDataFrame(data, "topic string, payload string, ingest_ts string")
    return parse.decode(frame.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp")))


def feature(spark, topic, payload):
    rows = features.snapshots(decoded(spark, (topic, payload))).collect()
    return rows[0]["features"] if rows else {}


def test_topic_split(spark):
    topics = [f"{ROOT}/dev-123/qoe", f"{ROOT}/dev-456/flowstatd/stats", "invalid/topic", f"{ROOT}/d/a/b/c", "other/d/qoe"]
    rows = parse.split_topic(spark.createDataFrame([(t,) for t in topics], "topic string")).collect()
    assert [(r.device_id, r.msg_type, r.subtopic) for r in rows] == [
        ("dev-123", "qoe", ""), ("dev-456", "flowstatd", "stats"), (None, None, None), ("d", "a", "b/c"), (None, None, None),
    ]


def test_topic_filter(spark):
    topics = ["d/bbst", "d/flowstatd/stats", "d/flowstatd", "d/flowstatd/a/b", "d/unknown", "d/qoe/x", "d/e/qoe"]
    frame = spark.createDataFrame([(f"{ROOT}/{t}",) for t in topics], "topic string")
    kept = [r.topic.removeprefix(f"{ROOT}/") for r in parse.subscribed(frame).collect()]
    assert kept == ["d/bbst", "d/flowstatd/stats", "d/flowstatd", "d/flowstatd/a/b"]


def test_reasons(spark):
    bad_score = {**QOE, "compositeScore": 101}
    no_id = {k: v for k, v in QOE.items() if k != "id"}
    rows = decoded(
        spark, ("d/qoe", QOE), ("d/qoe", "not json"), ("d/unknown", {"key": "value"}), ("d/unknown", "{"),
        ("d/qoe", bad_score), ("d/qoe", no_id), ("d/flowstatd/other", {}), ("d/wifi", {}), ("d/wifi", "null"),
        ("d/events", {"id": "e", "deviceId": "d", "type": "t", "severity": "fatal", "timestamp": "2026-04-01T12:00:00Z"}),
        ("d/bbst", {**SPEED, "download": {"mbps": "fast"}}),
    ).collect()
    assert [r.reason for r in rows] == [
        None, "bad_json", "unknown_type", "bad_json", "failed_check", "failed_check", "unknown_subtopic", None,
        "failed_check", "failed_check", "failed_check",
    ]
    assert rows[0].qoe.compositeScore == 78 and str(rows[0].ts) == "2026-04-01 12:00:00"


def test_event_time_falls_back_to_arrival(spark):
    rows = decoded(spark, ("d/wifi", {}), ("d/classifi", {"flows": [], "timestamp": 1775044800})).collect()
    assert [str(r.ts) for r in rows] == ["2026-04-01 12:00:05", "2026-04-01 12:00:00"]


def test_speed(spark):
    got = feature(spark, "d/bbst", SPEED)
    assert got["dl_mbps_latest"] == 500 and got["ul_mbps_latest"] == 100 and got["latency_idle_ms"] == 5.0
    assert got["dl_bloat_pct"] == 200.0 and got["provisioned_dl_mbps"] == 600 and got["bloat_grade_dl"] == 1
    assert len(got) == 16


def test_speed_idle_zero(spark):
    slow = {**SPEED, "download": {"mbps": 100}, "upload": {"mbps": 50}, "latency": {"idleMs": 0, "downloadMs": 10, "uploadMs": 0}}
    got = feature(spark, "d/bbst", slow)
    assert got["dl_bloat_pct"] == pytest.approx(9900.0) and got["ul_bloat_pct"] == 0.0 and got["latency_idle_ms"] == 0.0


def test_worst_category_first_of_equals(spark):
    assert feature(spark, "d/qoe", QOE)["qoe_worst_category"] == 1
    level = json.loads(json.dumps(QOE))
    for c in level["categories"].values():
        c["score"] = 50
    assert feature(spark, "d/qoe", level)["qoe_worst_category"] == 0


def test_wifi(spark):
    empty = feature(spark, "d/wifi", {})
    assert empty["wifi_client_count"] == 0 and empty["wifi_avg_rssi"] == 0 and len(empty) == 14
    clients = [{"mac": str(i), "band": b, "channel": 1, "rssi": -50 - i} for i, b in enumerate(["2.4GHz", "2.4GHz", "5GHz"])]
    got = feature(spark, "d/wifi", {"clients": clients, "satellites": [{"id": "a", "mac": "m", "status": "offline"}]})
    assert got["wifi_client_count"] == 3 and got["wifi_pct_2_4ghz"] == pytest.approx(2 / 3)
    assert got["wifi_pct_5ghz"] == pytest.approx(1 / 3) and got["wifi_min_rssi"] == -52
    assert got["mesh_satellite_offline_count"] == 1 and got["mesh_max_hops"] == 1


def test_traffic_and_risk(spark):
    row = {"masterProtocol": "IP", "appProtocol": "x", "category": "Streaming", "totalBytes": 30, "flowCount": 2}
    got = feature(spark, "d/flowstatd/stats", {"device_mac": "m", "categories": [row, {**row, "category": "Web", "totalBytes": 10}]})
    assert got["traffic_streaming_pct"] == 0.75 and got["traffic_flow_count_1h"] == 4 and got["traffic_max_risk_score"] == 0
    assert feature(spark, "d/flowstatd/stats", {"device_mac": "m"})["traffic_voip_pct"] == 0
    flow = {"id": "f", "deviceId": "d", "srcIp": "a", "srcPort": 1, "dstIp": "b", "dstPort": 2, "protocol": "TCP"}
    got = feature(spark, "d/classifi", {"flows": [{**flow, "riskScore": 50}, {**flow, "riskScore": 51}]})
    assert got == {"traffic_high_risk_flow_count": 1.0, "traffic_max_risk_score": 51.0}


def test_event_increments(spark):
    event = {"id": "e", "deviceId": "d", "type": "connection_lost", "severity": "critical", "timestamp": "2026-04-01T12:00:00Z"}
    assert feature(spark, "d/events", event) == {"_event_critical_inc": 1.0, "_event_connection_lost_inc": 1.0}
    assert feature(spark, "d/events", {**event, "type": "x", "severity": "info"}) == {}
    meta = {"mac": "m", "model": "a", "firmware": "f", "status": "online", "timestamp": "2026-04-01T12:00:00Z"}
    assert feature(spark, "d/meta", meta) == {}


def test_archive_defaults(spark):
    raw = spark.read.schema(imports.SPEED_ARCHIVE).json(spark.sparkContext.parallelize(['{"starttime": 1700000000}']))
    row = imports.speed_archive(raw).first()
    assert row.device_id == "bbst-unknown" and row.bbst.id == "bbst-1700000000" and row.bbst.latency.idleMs == 0


def test_stream_equals_batch(spark, tmp_path):
    lines = [
        {"topic": f"{ROOT}/d{i}/bbst", "payload": json.dumps(SPEED) if i % 3 else "not json", "ingest_ts": f"2026-04-0{1 + i % 5}T00:00:00Z"}
        for i in range(30)
    ]
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(x) for x in lines[part * 10 : part * 10 + 10]))
    stream = messages.stream_messages(spark, str(tmp_path / "in"), files_per_trigger=1)
    start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    # A restart finds nothing new and repeats nothing.
    start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "snapshots"))
    batch = features.snapshots(parse.decode(messages.read_messages(spark, str(tmp_path / "in"))))
    assert sorted(r.device_id for r in got.collect()) == sorted(r.device_id for r in batch.collect())
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 10


def test_schema_names():
    assert MESSAGE.startswith("topic string")


def test_cooldown_over_batches(spark, tmp_path):
    """Scores out of order inside a batch, ties, and runs that hold over later batches."""
    import numpy as np

    from meshlight.streaming.cooldown import triggered_runs

    rng = np.random.default_rng(3)
    hour, batches, want = 3_600_000_000, [], []
    last = {}
    for number in range(4):
        rows = [(f"d{d}", int(number * 6 * hour + rng.integers(0, 6 * hour)), float(rng.uniform(0.4, 1))) for d in (0, 0, 0, 1) for _ in range(15)]
        rows += [("d0", rows[0][1], 0.99), ("d0", rows[0][1], 0.9)]
        batches.append(rows)
        for device, at, score in sorted(rows, key=lambda r: (r[1], -r[2])):
            if score >= 0.5 and at - last.get(device, -(10**18)) >= 4 * hour:
                last[device] = at
                want.append((device, at, score))
        frame = spark.createDataFrame(rows, "device_id string, us bigint, anomaly_score double")
        frame = frame.select("device_id", F.timestamp_micros("us").alias("ts"), "anomaly_score").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = (
        triggered_runs(stream, 0.5, 4, "6 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("device_id", F.unix_micros("ts").alias("us"), "anomaly_score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
