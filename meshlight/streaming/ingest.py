"""Streaming ingest: messages to the tables that every other operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshlight.operators import features, parse, partials
from meshlight.operators.features import hourly_usage
from meshlight.session import discard


def once(messages: DataFrame, within: str) -> DataFrame:
    """Messages without redelivered copies that arrive ``within`` that time of each other.

    A copy has topic and payload in common with its original. A payload without an id or timestamp of its
    own can rightly occur again, so it only counts as a copy at the same arrival time. Rows that arrive later
    than the watermark allows are dropped; give a time that covers the stream's disorder.
    """
    told = F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.timestamp"))
    # What the state holds of a message: 32 bytes. With its length first no topic reads as part of a payload.
    topic = F.coalesce(F.length("topic"), F.lit(-1)).cast("string")
    key = F.unhex(F.sha2(F.concat_ws("|", topic, "topic", "payload", F.coalesce(told, F.col("ingest_ts").cast("string"))), 256))
    marked = messages.withColumn("_copy", key).withWatermark("ingest_ts", within)
    return marked.dropDuplicatesWithinWatermark(["_copy"]).drop("_copy")


def heartbeats(decoded: DataFrame) -> DataFrame:
    """(device_id, ts, model, firmware, status, subscriber_id) of accepted heartbeats."""
    p = F.col("meta")
    return decoded.where(p.isNotNull()).select(
        "device_id", "ts", p["model"].alias("model"), p["firmware"].alias("firmware"), p["status"].alias("status"),
        p["subscriberId"].alias("subscriber_id"),
    )


def device_events(decoded: DataFrame) -> DataFrame:
    """(device_id, ts, id, type, severity) of accepted events."""
    p = F.col("events")
    return decoded.where(p.isNotNull()).select(
        "device_id", "ts", p["id"].alias("id"), p["type"].alias("type"), p["severity"].alias("severity")
    )


def start_ingest(
    messages: DataFrame, out: str, checkpoint: str, interval: str | None = None, redelivered_within: str | None = None
) -> StreamingQuery:
    """Decode a message stream into tables below ``out``: snapshots, hourly states of every feature
    (``partials``), heartbeats, events, usage, quarantine and counters (messages by outcome, a row per batch
    and outcome).

    Every micro-batch owns one folder per table and overwrites it, so a batch that is run again
    after a failure leaves no duplicate rows. ``redelivered_within`` drops copies (see ``once``). Without
    an interval all waiting input is processed and the query ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        # Decoded once, into files: each table reads the columns that it needs, and no executor holds the batch. The text
        # of a message is kept for the quarantine alone.
        spark, staged = batch.sparkSession, f"{out}/_decoded/batch={number}"
        rows = parse.decode(parse.subscribed(batch))
        rows = rows.withColumn("payload", F.when(F.col("reason").isNotNull(), F.col("payload")))
        rows.write.mode("overwrite").parquet(staged)
        decoded = spark.read.schema(rows.schema).parquet(staged)

        def put(rows: DataFrame, name: str, *by: str) -> None:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/{name}/batch={number}")

        try:
            found = features.snapshots(decoded)
            put(found.withColumn("date", F.to_date("ts")), "snapshots", "date")
            put(partials.of_maps(found), "hourly")
            put(heartbeats(decoded), "heartbeats")
            put(device_events(decoded).withColumn("date", F.to_date("ts")), "events", "date")
            put(hourly_usage(decoded), "usage")
            put(parse.quarantined(decoded), "quarantine")
            put(parse.counters(decoded), "counters")
        finally:
            discard(spark, staged)

    rows = once(messages, redelivered_within) if redelivered_within else messages
    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables; hourly states, usage and counters are added up over the batches."""
    rows = spark.read.parquet(f"{out}/{name}")
    if name == "hourly":
        return partials.added_up(rows, ["device_id", "feature", "chunk"], "state")
    if name == "usage":
        return rows.groupBy("device_id", "category", "hour").agg(
            *[F.sum(c).alias(c) for c in ("rx_bytes", "tx_bytes", "active_sec")]
        )
    if name == "counters":
        return rows.groupBy("outcome").agg(F.sum("messages").alias("messages"))
    return rows.drop("batch", "date")
