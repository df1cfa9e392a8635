"""Stored tables that take appends, upserts and deletions, and survive a job that is run again.

A table is a folder with a partition for each bucket of its keys. A write merges the buckets it touches
with their stored rows, writes the result to a staging folder, and then replaces those buckets alone. Every
write can be repeated with the same result: a key has one row, and which one is decided by the rows
themselves. A deleted key leaves a mark, so that its bucket is replaced too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlight.session import discard, written_at

BUCKETS = 16
_BUCKET, _GONE, _NEW = "_bucket", "_gone", "_new"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _row_hash(rows: DataFrame) -> Column:
    parts = [F.array_sort(F.map_entries(F.col(f"`{n}`"))) if t.startswith("map") else F.col(f"`{n}`") for n, t in rows.dtypes]
    return F.xxhash64(*parts)


def _merge(
    spark: SparkSession, path: str, rows: DataFrame, key: Sequence[str], order: Sequence[Column], buckets: int
) -> None:
    """Put the first row by ``order`` of each key, among the stored and the new rows, into the table."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh, fresh_path = written_at(rows.withColumn(_BUCKET, bucket), "stored-new")
    touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    both = fresh.withColumn(_NEW, F.lit(True))
    if exists(spark, path):
        held = spark.read.parquet(path).where(F.col(_BUCKET).isin(touched)).withColumn(_NEW, F.lit(False))
        both = both.unionByName(held.select(*both.columns))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order, _row_hash(rows)))
    first = both.withColumn("_place", place).where("_place = 1").drop("_place", _NEW)
    staged, staged_path = written_at(first, "stored-staged")
    if touched:
        # A large bucket is written by several tasks, each a file.
        writer = staged.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(_BUCKET).parquet(path)
    discard(spark, fresh_path, staged_path)


def append(spark: SparkSession, path: str, rows: DataFrame, key: Sequence[str] = ("id",), buckets: int = BUCKETS) -> None:
    """Add rows whose key the table does not have; a key that it has, or has had, keeps its row."""
    _merge(spark, path, rows.withColumn(_GONE, F.lit(False)), list(key), [F.col(_NEW)], buckets)


def upsert(
    spark: SparkSession, path: str, rows: DataFrame, key: Sequence[str] = ("id",), at: str | None = None, buckets: int = BUCKETS
) -> None:
    """Add rows, or put them in the place of those with their key.

    With ``at`` the latest row by that column stays, whichever was written last; without it the new one does.
    """
    order = [F.desc(at)] if at else []
    _merge(spark, path, rows.withColumn(_GONE, F.lit(False)), list(key), [*order, F.desc(_NEW)], buckets)


def delete(spark: SparkSession, path: str, keys: DataFrame, key: Sequence[str] = ("id",), buckets: int = BUCKETS) -> None:
    """Remove the rows with these keys; keys the table does not have are left alone."""
    key = list(key)
    if not exists(spark, path):
        return
    held = spark.read.parquet(path).drop(_BUCKET)
    marked = held.join(keys.select(*key).distinct(), key, "left_semi").withColumn(_GONE, F.lit(True))
    _merge(spark, path, marked.select(*held.columns), key, [F.desc(_NEW)], buckets)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table's rows; a table that nobody has written yet is empty with the given schema."""
    if not exists(spark, path):
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).where(~F.col(_GONE)).drop(_BUCKET, _GONE)
