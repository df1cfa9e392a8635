"""Trailing-window statistics, trends, threshold shares and drops over per-device series.

Windows end at each device's last observation and are open at the start. They are merged from states per
device and hour (``partials``): readings are aggregated map-side, and looked at again only in the hour that
a window's start cuts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight.operators import partials

_UNITS = {"m": partials.HOUR // 60, "h": partials.HOUR, "d": 24 * partials.HOUR}


def window_micros(window: str) -> int:
    """Length of "24h", "7d", "6 hours" or "90 minutes" in microseconds."""
    found = re.fullmatch(r"(\d+)\s*(m|h|d)(?:inutes?|ours?|ays?)?", window.strip())
    if not found:
        raise ValueError(f"no length of time: {window}")
    return int(found.group(1)) * _UNITS[found.group(2)]


def rolling_stats(
    series: DataFrame, by: Sequence[str] = ("device_id",), value: str = "value", window: str = "24h"
) -> DataFrame:
    """Mean, sample deviation, min, max and row count of the trailing window; 0 where undefined."""
    rows = series.select(*by, "ts", F.col(value).alias("value"))
    found = partials.trailing(rows, by, ["value"], {"w": window_micros(window)}, keep_nulls=True)
    s, zero = F.col("state"), F.lit(0.0)
    return found.select(
        *by, F.coalesce(s["mean"], zero).alias("mean"), partials.deviation(s).alias("std"), F.coalesce(s["low"], zero).alias("min"),
        F.coalesce(s["high"], zero).alias("max"), s["rows"].alias("count"),
    )


def rolling_rows(
    series: DataFrame, by: Sequence[str] = ("device_id",), value: str = "value", window: str = "24h"
) -> DataFrame:
    """Every reading with the statistics of the window that ends at it; see ``partials.per_reading``."""
    return partials.per_reading(series, by, value, window_micros(window))


def linear_trend(
    series: DataFrame, by: Sequence[str] = ("device_id",), value: str = "value", window: str | None = None
) -> DataFrame:
    """Least-squares slope per day; 0 with fewer than two points or a single instant.

    A slope does not depend on where time starts, so that without a window one aggregation is enough.
    """
    if window:
        rows = series.select(*by, "ts", F.col(value).alias("value"))
        found = partials.trailing(rows, by, ["value"], {"w": window_micros(window)}, keep_nulls=True)
        return found.select(*by, partials.slope(F.col("state")).alias("slope"))
    slope = F.regr_slope(F.col(value), partials.days(F.col("ts")) - 19_723.0)
    return series.groupBy(*by).agg(F.coalesce(slope, F.lit(0.0)).alias("slope"))


def fraction_below(
    series: DataFrame, threshold: float, by: Sequence[str] = ("device_id",), value: str = "value"
) -> DataFrame:
    """Share of rows strictly below the threshold; a null value counts as not below."""
    return series.groupBy(*by).agg(
        F.avg(F.when(F.col(value) < threshold, 1.0).otherwise(0.0)).alias("fraction_below")
    )


def _drops_per_chunk(rows: DataFrame, by: Sequence[str], value: str, drop: float) -> DataFrame:
    """(by, _chunk, _drops, _first, _last, _from, _to): drops inside each chunk, its outer readings and times."""
    inside = Window.partitionBy(*by, "_chunk").orderBy("ts", value)
    step = F.col(value) - F.lag(value).over(inside)
    order = F.struct("ts", value)
    return (
        rows.withColumn("_drop", F.when(step < -drop, 1).otherwise(0))
        .groupBy(*by, "_chunk")
        .agg(
            F.sum("_drop").alias("_drops"),
            F.min_by(value, order).alias("_first"),
            F.max_by(value, order).alias("_last"),
            partials.micros(F.min("ts")).alias("_from"),
            partials.micros(F.max("ts")).alias("_to"),
        )
    )


def _drops_stitched(per_chunk: DataFrame, by: Sequence[str], drop: float) -> DataFrame:
    across = Window.partitionBy(*by).orderBy("_chunk")
    border = F.col("_first") - F.lag("_last").over(across)
    return (
        per_chunk.withColumn("_border", F.when(border < -drop, 1).otherwise(0))
        .groupBy(*by)
        .agg(F.sum(F.col("_drops") + F.col("_border")).alias("drops"))
    )


def count_drops(
    series: DataFrame,
    drop: float = 10.0,
    by: Sequence[str] = ("device_id",),
    value: str = "value",
    length: int | None = None,
) -> DataFrame:
    """Number of consecutive readings that fall by more than ``drop``.

    Readings are compared inside time chunks and then across chunk borders, so that the largest
    sort is one device's chunk; by default an hour, cut finer where a device has many readings in one
    (``partials.chunk_length``). Readings at one time are in order of value.
    """
    by = list(by)
    length = length or partials.chunk_length(series, by)
    rows = series.withColumn("_chunk", partials.chunk_start(partials.micros(F.col("ts")), length))
    return _drops_stitched(_drops_per_chunk(rows, by, value, drop), by, drop)


def bundle(
    snapshots: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = ("device_id",),
    windows: Sequence[str] = ("24h", "7d"),
    names: dict[str, str] | None = None,
    thresholds: dict[str, float] | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """Mean, deviation and minimum per window plus the 7-day slope, for many features in one pass.

    Nulls are dropped per feature before its window is anchored. ``names`` gives a feature another
    stem (``qoe_composite_latest`` to ``qoe_composite``). The slope is null when the device has
    fewer than two values of the feature at all. A feature with one of the ``thresholds`` also has the share
    of its values below it in the last seven days, as ``{stem}_below_7d``. ``held`` are the hourly states of
    the features, if at hand.
    """
    by, names = list(by), names or {}
    rows = snapshots.select(*by, "ts", *features)
    spans = {w: window_micros(w) for w in dict.fromkeys([*windows, "7d"])}
    if held is None:
        held = partials.written(partials.states(rows, by, features, thresholds=thresholds), "chunk-states")
    long = partials.trailing(rows, by, features, spans, thresholds=thresholds, held=held)
    s, columns = F.col("state"), {}
    for f in features:
        stem = names.get(f, f)
        for w in windows:
            columns[f"{stem}_mean_{w}"] = (f, w, s["mean"])
            columns[f"{stem}_std_{w}"] = (f, w, F.when(s["n"] > 0, partials.deviation(s)))
            columns[f"{stem}_min_{w}"] = (f, w, s["low"])
        if f in (thresholds or {}):
            columns[f"{stem}_below_7d"] = (f, "7d", F.try_divide(s["below"], s["n"]))
        columns[f"{stem}_trend_7d"] = (f, "7d", partials.slope(s))
    everyone = held.groupBy(*by).agg(*[F.sum(F.col(f)["n"]).alias(f"_n_{f}") for f in features])
    out = everyone.join(partials.wide(long, by, columns), by, "left")
    for f in features:
        trend = f"{names.get(f, f)}_trend_7d"
        out = out.withColumn(trend, F.when(F.col(f"_n_{f}") >= 2, F.coalesce(trend, F.lit(0.0)))).drop(f"_n_{f}")
    return out


def trailing_drops(
    rows: DataFrame, by: Sequence[str], value: str, window: str, drop: float = 10.0, ends: DataFrame | None = None,
    length: int | None = None,
) -> DataFrame:
    """``count_drops`` over the trailing window of each group, nulls left out.

    Chunks inside the window are compared as they are; of the chunk that a window's start cuts the readings
    after the start are compared once more. ``ends`` (by, end) are the groups' last times, if at hand.
    """
    by, reach = list(by), window_micros(window)
    length = length or partials.chunk_length(rows, by)
    at = partials.micros(F.col("ts"))
    here = rows.where(F.col(value).isNotNull()).select(*by, "ts", value)
    ends = here.groupBy(*by).agg(F.max("ts").alias("end")) if ends is None else ends
    # No reading before the earliest start of all groups matters.
    first = ends.agg(F.min(partials.micros(F.col("end"))) - reach).scalar()
    here = here.withColumn("_least", first).where(at > F.col("_least")).drop("_least")
    here = here.withColumn("_chunk", partials.chunk_start(at, length))
    chunks = partials.written(_drops_per_chunk(here, by, value, drop), "drops")
    chunks = chunks.withColumn("_start", F.max("_to").over(Window.partitionBy(*by)) - reach)
    whole = chunks.where(F.col("_from") > F.col("_start"))
    cut = chunks.where((F.col("_from") <= F.col("_start")) & (F.col("_to") > F.col("_start")))
    keys = cut.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_chunk").alias("_k"), F.col("_start"))
    span = keys.agg(F.struct(F.min("_k").alias("a"), F.max("_k").alias("b")).alias("s")).scalar()
    near = here.withColumn("_span", span).where(F.col("_chunk").between(F.col("_span.a"), F.col("_span.b"))).drop("_span")
    same = [F.col(c) == F.col(f"_k_{c}") for c in by] + [F.col("_chunk") == F.col("_k")]
    late = near.join(keys, same).where(at > F.col("_start")).select(*by, "ts", value, "_chunk")
    columns = [*by, "_chunk", "_drops", "_first", "_last"]
    parts = whole.select(*columns).unionByName(_drops_per_chunk(late, by, value, drop).select(*columns))
    return _drops_stitched(parts, by, drop)
