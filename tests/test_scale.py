"""How the work is dealt: tasks, passes and joins that decide time and memory on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshlight.operators import parse, remediation
from meshlight.plans import catalog_ingest, catalog_models, catalog_streaming
from meshlight.sources import messages, stored
from meshlight.sources import tables as T
from meshlight.streaming import ingest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A table of events and one of customers, a file each."""
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = F.array(*[F.lit(k) for k in ("view", "signup", "click", "purchase", "error")])
    spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") * 0.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    ).coalesce(1).write.parquet(f"{path}/events.parquet")
    spark.range(5).select(F.col("id").alias("c_custkey"), F.format_string("C%d", "id").alias("c_name")).coalesce(1).write.parquet(
        f"{path}/customer.parquet"
    )
    return path


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [T.messages, catalog_ingest._polls])
def test_messages_of_one_file_are_made_on_all_cores(spark, made, rows):
    assert rows(spark, made).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_redelivered_messages_are_made_once(spark, made):
    sent = T.messages(spark, made)
    found = catalog_streaming._sent_again(sent)
    assert _plan(found).count("FileScan") == 1
    told = F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.timestamp")).isNotNull()
    again = sent.where(told).withColumn("ingest_ts", F.col("ingest_ts") + F.expr("interval 1 second"))
    assert sorted(found.collect()) == sorted(sent.union(again).collect())


def test_ingest_holds_no_batch_in_the_executors(spark, made, tmp_path, monkeypatch):
    sent, out = T.messages(spark, made), str(tmp_path / "out")
    messages.write_messages(sent, f"{out}/incoming")
    assert all(f.endswith(".lz4") for f in spark.read.text(f"{out}/incoming").inputFiles())
    assert sorted(messages.read_messages(spark, f"{out}/incoming").collect()) == sorted(sent.collect())
    monkeypatch.setattr(type(sent), "persist", lambda *_: pytest.fail("held in memory"))
    ingest.start_ingest(messages.stream_messages(spark, f"{out}/incoming"), out, f"{out}/state").awaitTermination()
    rejected = parse.decode(parse.subscribed(sent)).where("reason IS NOT NULL").select("topic", "payload", "reason")
    found = spark.read.parquet(f"{out}/quarantine").select("topic", "payload", "reason")
    assert sorted(found.collect()) == sorted(rejected.collect()) and not rejected.isEmpty()
    assert not (tmp_path / "out/_decoded/batch=0").exists()


def test_the_state_of_a_redelivery_is_one_short_key(spark, made):
    sent = T.messages(spark, made)
    once = ingest.once(sent, "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "[_copy#" in once and "topic#" not in once.split("DeduplicateWithinWatermark [")[1].split("]")[0]


def test_text_that_begins_like_a_date_is_not_tried_as_a_number(spark):
    texts = [
        "2026-04-01T12:00:00Z", "2026-04-01", "2026-4-1 1:2:3", "1704067200", "1704067200.25", "1.0e-5", "1e9", " 12 ", "2024", "2024-", "20240101",
        "12345-01-01", "+2026-01-01", "NaN", "Infinity", "soon", "", "2026-13-45", "1700-1", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.col("t")
    before = F.coalesce(F.timestamp_seconds(text.try_cast("double")), text.try_cast("timestamp"))
    found = rows.select("t", parse.timestamp_of(text).cast("string").alias("new"), before.cast("string").alias("old")).collect()
    assert all(r["new"] == r["old"] for r in found)
    assert "RLIKE" in _plan(rows.repartition(2).select(parse.timestamp_of(text)))


def test_device_tables_are_not_broadcast(spark, made):
    for rows in (T.heartbeats(spark, made), catalog_models.measured(spark, made)):
        assert "BroadcastHashJoin" not in _plan(rows)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    path, setting = str(tmp_path / "table"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64k")
    try:
        rows = spark.range(60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        stored.append(spark, path, rows, buckets=1)
        stored.append(spark, path, rows, buckets=1)
    finally:
        spark.conf.set(setting, before)
    assert len(spark.read.parquet(path).inputFiles()) > 1
    assert stored.read(spark, path).exceptAll(rows).isEmpty() and stored.read(spark, path).count() == 60000


def test_decisions_are_gathered_once(spark):
    recs = spark.createDataFrame([("a", "pending"), ("b", "pending"), (None, "pending")], "id string, status string")
    log = [("a", 2, "dismissed", "u"), ("a", 2, "approved", "v"), ("a", None, "z", "z"), (None, 1, "approved", "u"), ("c", 1, "approved", "u")]
    decisions = spark.createDataFrame(log, "id string, at int, status string, decided_by string").withColumn(
        "decided_at", F.timestamp_seconds("at")
    ).drop("at")
    found = remediation._applied(recs, decisions, "inner").collect()
    assert [(r["id"], r["status"], r["executed_by"]) for r in found] == [("a", "dismissed", None)]
    assert sorted(map(str, remediation.decided(recs, decisions).where("id = 'a'").collect())) == sorted(map(str, found))
