"""Snapshots of the past, laid out by day and by bucket of devices.

Ingest writes a folder for each micro-batch. ``compact`` moves whole batches into the history, whose files are
sorted by device and time, so that one device's week reads its own bucket of seven days. It can be run again
after a failure: rows keep the number of their batch, a day's rows of the batches at hand are replaced
as a whole, and batches count as moved only once a mark behind them says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.session import discard, written_at
from meshlight.sources.stored import exists

BUCKETS = 16
_HISTORY, _MARKS = "history", "history_marks"


def _bucket(device: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(device), F.lit(BUCKETS)).cast("int")


def moved_up_to(spark: SparkSession, out: str) -> int:
    """Number of the last batch that is in the history; -1 for none."""
    if not exists(spark, f"{out}/{_MARKS}"):
        return -1
    found = spark.read.parquet(f"{out}/{_MARKS}").agg(F.max("upto")).first()[0]
    return -1 if found is None else int(found)


def compact(spark: SparkSession, out: str) -> int:
    """Move all finished batches of snapshots into the history; the number of the last one."""
    before = moved_up_to(spark, out)
    fresh = spark.read.parquet(f"{out}/snapshots").where(F.col("batch") > before)
    last = fresh.agg(F.max("batch")).first()[0]
    if last is None:
        return before
    rows = fresh.where(F.col("batch") <= last).withColumn("bucket", _bucket(F.col("device_id")))
    path = f"{out}/{_HISTORY}"
    if exists(spark, path):
        days = [r[0] for r in rows.select("date").distinct().collect()]  # the days that these batches touch
        held = spark.read.parquet(path).where(F.col("date").isin(days) & (F.col("batch") <= before))
        rows = rows.unionByName(held.select(*rows.columns))
    staged, staged_path = written_at(rows, "history")
    ordered = staged.repartition("date", "bucket").sortWithinPartitions("date", "bucket", "device_id", "ts")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "bucket").parquet(path)
    mark = spark.createDataFrame([(int(last),)], "upto bigint")
    mark.write.mode("append").parquet(f"{out}/{_MARKS}")
    discard(spark, staged_path)
    return int(last)


def read_history(
    spark: SparkSession, out: str, device_id: str | None = None, from_ts: str | None = None, to_ts: str | None = None
) -> DataFrame:
    """Snapshots (device_id, ts, msg_type, features) of the history and of the batches not in it yet.

    Device and times are put on the partition columns as well, so that other days and buckets are not read.
    """
    upto = moved_up_to(spark, out)
    parts = []
    if exists(spark, f"{out}/{_HISTORY}"):
        old = spark.read.parquet(f"{out}/{_HISTORY}").where(F.col("batch") <= upto)
        parts.append(old if device_id is None else old.where(F.col("bucket") == _bucket(F.lit(device_id))))
    parts.append(spark.read.parquet(f"{out}/snapshots").where(F.col("batch") > upto))
    found = None
    for rows in parts:
        if device_id is not None:
            rows = rows.where(F.col("device_id") == device_id)
        for bound, compare in ((from_ts, "__ge__"), (to_ts, "__le__")):
            if bound:
                limit = F.lit(bound).cast("timestamp")
                rows = rows.where(getattr(F.col("date"), compare)(F.to_date(limit)) & getattr(F.col("ts"), compare)(limit))
        rows = rows.select("device_id", "ts", "msg_type", "features")
        found = rows if found is None else found.unionByName(rows)
    return found
