"""Queries over feature snapshots: history, latest per device, merged latest, projections, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.session import written


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns (maps by their sorted entries): a tie-break that only the data decide."""
    parts = [F.array_sort(F.map_entries(F.col(f"`{n}`"))) if t.startswith("map") else F.col(f"`{n}`") for n, t in rows.dtypes]
    return F.xxhash64(*parts)


def history(snapshots: DataFrame, device_id: str, to_ts: str, from_ts: str | None = None) -> DataFrame:
    """Snapshots of one device between two times, both included; by default the last seven days."""
    end = F.lit(to_ts).cast("timestamp")
    start = F.lit(from_ts).cast("timestamp") if from_ts else end - F.expr("interval 7 days")
    return snapshots.where((F.col("device_id") == device_id) & F.col("ts").between(start, end)).orderBy("ts")


def as_columns(snapshots: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """Features of the map as columns; a feature the snapshot lacks is null."""
    kept = [c for c in snapshots.columns if c != features]
    return snapshots.select(*kept, *[F.try_element_at(F.col(features), F.lit(n)).alias(n) for n in names])


def only(snapshots: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """Snapshots whose map is cut down to the named features."""
    return snapshots.withColumn(features, F.map_filter(features, lambda k, _: k.isin(list(names))))


def latest_of(snapshots: DataFrame, device_id: str) -> DataFrame:
    """The newest snapshot of one device; of several at one time the one with the largest hash."""
    own = snapshots.where(F.col("device_id") == device_id)
    return own.orderBy(F.desc("ts"), row_hash(own).desc()).limit(1)


def _order(time: Column, tie: Column) -> Column:
    """One number that sorts rows by time (``_of_time``) and then by a 64-bit hash.

    Its size is fixed, so that picking values by it is a hash aggregation; a struct or a text as
    the order would have Spark sort the raw rows.
    """
    return time + tie.cast("decimal(20,0)")


def _of_time(ts: str) -> Column:
    return F.unix_micros(ts).cast("decimal(20,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")


def fleet_latest(
    snapshots: DataFrame,
    columns: Sequence[str],
    device_ids: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The newest snapshot of every device, taken whole: a feature it lacks stays null.

    One hash aggregation with map-side combine (for columns of fixed size), so a device with a third of all
    rows ships one row per task. ``device_ids`` (column device_id) restricts the fleet; ``limit`` keeps the
    first devices by id. Of several snapshots at one time the one with the largest hash counts.
    """
    rows = snapshots if device_ids is None else snapshots.join(device_ids, "device_id", "left_semi")
    last = _order(_of_time("ts"), row_hash(rows))  # one row decides every column, also among equal times
    # The key travels as a column of its own, or every aggregate would work it out anew.
    newest = rows.withColumn("_last", last).groupBy("device_id").agg(
        F.max("ts").alias("ts"), *[F.max_by(c, "_last").alias(c) for c in columns]
    )
    return newest if limit is None else newest.orderBy("device_id").limit(limit)


def fleet_merged(snapshots: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Per device and feature, the last value that is not null, across message types.

    Of several values at one time the one with the largest hash counts. ``extra`` are further aggregates
    over the same rows. One hash aggregation.
    """
    merged = [
        F.max_by(c, F.when(F.col(f"`{c}`").isNotNull(), _order(F.col("_time"), F.xxhash64(f"`{c}`")))).alias(c) for c in columns
    ]
    return snapshots.withColumn("_time", _of_time("ts")).groupBy("device_id").agg(F.max("ts").alias("ts"), *merged, *extra)


def page(
    rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, total: bool = True
) -> DataFrame:
    """One page of a sorted list with the total number of rows; ``order`` must end in a unique key.

    With the total the rows are written first and counted from the files' heads, so that what makes them
    runs once.
    """
    held = written(rows, "page") if total else rows
    out = held.orderBy(*order).offset(offset).limit(limit)
    if total:
        out = out.withColumn("total", held.agg(F.count(F.lit(1))).scalar())
    return out
