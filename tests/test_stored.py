"""Stored tables and histories: writes that are repeated, interrupted or out of order."""

import json

import pytest
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.operators import registry, remediation, serving
from meshlight.sources import history, messages, stored
from meshlight.streaming.ingest import ingested, start_ingest


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, at int, text string")


def held(spark, path):
    return {r.id: r.text for r in stored.read(spark, path).collect()}


def test_append_keeps_and_upsert_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.read(spark, path, "id string, at int, text string").count() == 0
    with pytest.raises(FileNotFoundError):
        stored.read(spark, path)
    stored.delete(spark, path, frame(spark, [("a", 1, "x")]))
    for _ in range(2):
        stored.append(spark, path, frame(spark, [("a", 1, "first"), ("b", 1, "b"), ("b", 1, "b")]))
    stored.append(spark, path, frame(spark, [("a", 2, "second"), ("c", 1, "c")]))
    assert held(spark, path) == {"a": "first", "b": "b", "c": "c"}
    stored.upsert(spark, path, frame(spark, [("a", 0, "written last")]))
    assert held(spark, path)["a"] == "written last"
    stored.upsert(spark, path, frame(spark, [("a", 9, "latest"), ("a", 3, "older")]), at="at")
    stored.upsert(spark, path, frame(spark, [("a", 5, "late arrival")]), at="at")
    assert held(spark, path) == {"a": "latest", "b": "b", "c": "c"}
    stored.append(spark, path, frame(spark, []))
    for _ in range(2):
        stored.delete(spark, path, spark.createDataFrame([("b",), ("zz",)], "id string"))
    assert held(spark, path) == {"a": "latest", "c": "c"}
    stored.append(spark, path, frame(spark, [("b", 1, "again")]))
    assert "b" not in held(spark, path)
    stored.upsert(spark, path, frame(spark, [("b", 1, "again")]))
    assert held(spark, path)["b"] == "again"


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.append(spark, path, frame(spark, [(str(i), i, "x") for i in range(200)]))
    files = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    stored.upsert(spark, path, frame(spark, [("7", 7, "new")]))
    after = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert len(files) > 8 and len(files - after) == 1
    assert held(spark, path) == {str(i): "new" if i == 7 else "x" for i in range(200)}


def test_decisions_are_applied_once(spark, tmp_path):
    path = str(tmp_path / "recs")
    recs = spark.createDataFrame([("1", "d", "pending"), ("2", "d", "pending")], "id string, device_id string, status string")
    made = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00", "approved", "u"), ("9", "2024-01-01 00:00:00", "approved", "u")],
        "id string, decided_at string, status string, decided_by string",
    ).withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    for _ in range(2):
        remediation.add_recommendations(spark, path, recs)
        assert [r.id for r in remediation.decide(spark, path, made).collect()] == ["9"]
    assert {r.id: (r.status, r.executed_by) for r in stored.read(spark, path).collect()} == {"1": ("approved", "u"), "2": ("pending", None)}


def test_no_active_model_has_no_scores(spark):
    log = spark.createDataFrame(
        [("anomaly_detector", "v1", "2024-01-01", False, "nowhere"), ("other", "v1", "2024-01-01", True, "nowhere")],
        "name string, version string, trained_at string, activate boolean, artifact_path string",
    ).withColumn("trained_at", F.col("trained_at").cast("timestamp"))
    assert serving.active_artifacts(log) == {}
    assert serving.active_scores(spark, log, spark.createDataFrame([("d",)], "device_id string")).count() == 0
    assert registry.active_versions(log).count() == 1


def test_history_is_compacted_once(spark, tmp_path, monkeypatch):
    def message(day, device, mbps):
        side = {"mbps": mbps, "capacityPercent": 1.0, "bloatPercent": 1.0, "bloatGrade": "A", "provisionedMbps": 100}
        latency = {"idleMs": 1.0, "downloadMs": 2.0, "uploadMs": 2.0, "idleJitterMs": 1.0, "downloadJitterMs": 1.0}
        at = f"2026-04-0{day}T12:00:00Z"
        body = {"id": f"{day}{device}{mbps}", "deviceId": device, "timestamp": at, "download": side, "upload": side, "latency": latency, "durationSec": 1.0}
        return json.dumps({"topic": f"{V.TOPIC_ROOT}/{device}/bbst", "payload": json.dumps(body), "ingest_ts": at})

    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def send(name, lines):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines))
        start_ingest(messages.stream_messages(spark, str(tmp_path / "in")), out, str(tmp_path / "state")).awaitTermination()

    send(0, [message(d, f"dev-{i}", 10.0 + i) for d in (1, 2, 3) for i in range(20)])
    with monkeypatch.context() as interrupted:  # a job that ends before its mark
        interrupted.setattr(history, "_MARKS", "lost_marks")
        history.compact(spark, out)
    assert history.read_history(spark, out).count() == 60
    assert history.compact(spark, out) == 0 and history.compact(spark, out) == 0
    send(1, [message(d, f"dev-{i}", 50.0) for d in (3, 4) for i in range(10)])
    every = lambda: sorted((r.device_id, r.ts, r.features["dl_mbps_latest"]) for r in history.read_history(spark, out).collect())
    before = every()
    assert len(before) == 80 and history.compact(spark, out) == 1 and every() == before
    own = history.read_history(spark, out, "dev-3", "2026-04-02 00:00:00", "2026-04-03 23:00:00")
    assert sorted(r.features["dl_mbps_latest"] for r in own.collect()) == [13.0, 13.0, 50.0]
    plan = own._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Hourly states come from all batches as well.
    states = ingested(spark, out, "hourly").where("device_id = 'dev-3' AND feature = 'dl_mbps_latest'").collect()
    assert sorted((r.state.n, r.state.mean) for r in states) == [(1, 13.0), (1, 13.0), (1, 50.0), (2, 31.5)]
    assert len(states) == 4
