"""Telemetry sources: message files or Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.sources.schemas import MESSAGE


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Stored messages as a batch: JSON lines with topic, payload, ingest_ts."""
    return spark.read.schema(MESSAGE).json(path)


def write_messages(rows: DataFrame, path: str) -> None:
    """Store messages as compressed JSON lines with their arrival time to the microsecond."""
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("compression", "lz4").json(path)


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream."""
    reader = spark.readStream.schema(MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Messages bridged into Kafka, the device topic as key; needs the Kafka connector on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics).load()
    return raw.select(
        F.col("key").cast("string").alias("topic"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("ingest_ts"),
    )
