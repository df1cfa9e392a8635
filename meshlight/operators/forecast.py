"""Quality forecasts for all devices in one job.

A device has at most 672 quarter-hour steps of history and of horizon, so every per-device group
here is bounded; raw readings are reduced to steps by a map-side combined aggregation first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.rounding import round_even
from meshlight.operators.counters import within

_STEP_US = V.STEP_MINUTES * 60 * 1_000_000
Z95 = 1.96


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def steps(series: DataFrame, as_of: str) -> DataFrame:
    """Quarter-hour means of the last seven days (device_id, step, value, last_ts).

    ``step`` counts quarter hours since the epoch; ``series`` is (device_id, ts, value).
    """
    recent = series.where(within(F.col("ts"), as_of, 7) & F.col("value").isNotNull())
    step = F.floor(F.unix_micros("ts") / F.lit(_STEP_US))
    return recent.groupBy("device_id", step.alias("step")).agg(
        F.avg("value").alias("value"),
        F.max("ts").alias("last_ts"),
        F.max_by("value", "ts").alias("last_value"),
    )


def gap_filled(resampled: DataFrame) -> DataFrame:
    """All steps between a device's first and last, with null where nothing was read."""
    span = resampled.groupBy("device_id").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    grid = span.select("device_id", F.explode(F.sequence("a", "b")).alias("step"))
    return grid.join(resampled.select("device_id", "step", "value"), ["device_id", "step"], "left")


def tier(points: Column) -> Column:
    return (
        F.when(points < V.MIN_STEPS, "none")
        .when(points < V.DAY_STEPS, "no_season")
        .when(points < V.WEEK_STEPS, "short_season")
        .otherwise("full_season")
    )


def summary(devices: DataFrame, resampled: DataFrame) -> DataFrame:
    """Per device: points, tier, current value and a warning.

    A device without any history gets 0.0 and its own warning; too little history, another one.
    """
    have = resampled.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("last_value", "last_ts").alias("current"),
    )
    points = F.coalesce("points", F.lit(0))
    warning = F.when(points == 0, V.FORECAST_WARNINGS["none"]).when(
        points < V.MIN_STEPS, V.FORECAST_WARNINGS["short"]
    )
    return devices.join(have, "device_id", "left").select(
        "device_id",
        points.alias("points"),
        tier(points).alias("tier"),
        "last_ts",
        F.coalesce(round_even(F.col("current"), 2), F.lit(0.0)).alias("current"),
        warning.alias("warning"),
    )


def _horizon(heads: DataFrame, horizon: int) -> DataFrame:
    """One row per device and future step; ``ts`` continues from the last reading."""
    return heads.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("last_ts") + F.col("i").cast("bigint") * F.lit(_STEP_US))
    )


def _banded(rows: DataFrame, middle: Column, half: Column) -> DataFrame:
    return rows.select(
        "device_id", "i", "ts", _clip(middle).alias("predicted"),
        _clip(middle - half).alias("lower95"), _clip(middle + half).alias("upper95"),
    )


def presented(forecast: DataFrame) -> DataFrame:
    """Forecast points rounded to two digits, as reported; trends use the unrounded ones."""
    return forecast.withColumns({c: round_even(F.col(c), 2) for c in ("predicted", "lower95", "upper95")})


def moving_average(resampled: DataFrame, horizon: int = V.DAY_STEPS) -> DataFrame:
    """Flat forecast: mean of the last min(n, 96) points, band of two deviations (5.0 for one point)."""
    newest = Window.partitionBy("device_id").orderBy(F.desc("step"))
    recent = resampled.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= V.DAY_STEPS)
    heads = recent.groupBy("device_id").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(5.0)).alias("std"),
        F.max("last_ts").alias("last_ts"),
    )
    return _banded(_horizon(heads, horizon), F.col("mean"), 2.0 * F.col("std"))


def seasonal(resampled: DataFrame, horizon: int = V.DAY_STEPS) -> DataFrame:
    """Trend plus daily profile: least-squares line through the device's points, mean deviation per
    quarter hour of the day (only from 96 points up), band of 1.96 residual deviations.

    Devices below 48 points get no rows.
    """
    heads = resampled.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("points"), F.max("step").alias("last_step"), F.max("last_ts").alias("last_ts")
    ).where(F.col("points") >= V.MIN_STEPS)
    x = (F.col("step") - F.col("last_step")).cast("double")
    rows = resampled.drop("last_ts").join(heads, "device_id").withColumn("x", x)
    line = rows.groupBy("device_id").agg(
        F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("level")
    )
    slot = F.pmod("step", F.lit(V.DAY_STEPS))
    off = rows.join(line, "device_id").select(
        "device_id",
        "points",
        slot.alias("slot"),
        (F.col("value") - F.col("level") - F.col("slope") * F.col("x")).alias("off"),
    )
    per_slot = off.groupBy("device_id", "slot").agg(
        F.avg("off").alias("mean_off"), F.sum(F.col("off") * F.col("off")).alias("squares"),
        F.count(F.lit(1)).alias("n"), F.max("points").alias("points"),
    )
    profile = per_slot.withColumn(
        "season", F.when(F.col("points") >= V.DAY_STEPS, F.col("mean_off")).otherwise(0.0)
    )
    # Residual squares per slot: sum (off - season)^2, from the slot's own sums.
    left = F.col("squares") - 2.0 * F.col("season") * F.col("mean_off") * F.col("n") + F.col("n") * F.pow("season", F.lit(2))
    sigma = profile.groupBy("device_id").agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(left)) / F.greatest(F.sum("n") - 1, F.lit(1))).alias("sigma")
    )
    future = _horizon(heads.join(line, "device_id").join(sigma, "device_id"), horizon).withColumn(
        "slot", F.pmod(F.col("last_step") + F.col("i"), F.lit(V.DAY_STEPS))
    )
    joined = future.join(profile.select("device_id", "slot", "season"), ["device_id", "slot"], "left")
    middle = F.col("level") + F.col("slope") * F.col("i") + F.coalesce("season", F.lit(0.0))
    return _banded(joined, middle, Z95 * F.col("sigma"))


def trend(forecast: DataFrame) -> DataFrame:
    """Direction per device: change per hour over the horizon against half a point."""
    ends = forecast.groupBy("device_id").agg(
        F.min_by("predicted", "i").alias("first"),
        F.max_by("predicted", "i").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    per_hour = (F.col("last") - F.col("first")) / F.col("n") * 4
    direction = F.when(per_hour > 0.5, "improving").when(per_hour < -0.5, "declining").otherwise("stable")
    return ends.select("device_id", F.when(F.col("n") >= 2, direction).otherwise("stable").alias("trend"))
