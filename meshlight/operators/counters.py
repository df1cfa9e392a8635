"""Windowed event counters, subscriber rollups and device metadata, all as of an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.operators import partials, temporal
from meshlight.operators.ordering import row_numbers


def _time(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def within(ts: Column, as_of: str | Column, days: float) -> Column:
    """True in the ``days`` before ``as_of``: open at the start, closed at the end."""
    end = _time(as_of)
    return (ts > end - F.make_dt_interval(F.lit(0), F.lit(int(days * 24)))) & (ts <= end)


def event_counters(events: DataFrame, as_of: str | Column, by: str = "device_id") -> DataFrame:
    """Counts of critical and warning events (24 h), of all and of three types (7 d), of all (30 d).

    ``events`` has (by, ts, type, severity). The 30-day bound is a plain filter on ts, which reaches
    the scan; the rest is one aggregation with map-side combine.
    """
    ts = F.col("ts")

    def count(days: int, condition: Column | None = None) -> Column:
        hit = within(ts, as_of, days)
        return F.count_if(hit if condition is None else hit & condition)

    kind, severity = F.col("type"), F.col("severity")
    return (
        events.where(within(ts, as_of, 30))
        .groupBy(by)
        .agg(
            count(1, severity == "critical").alias("events_critical_24h"),
            count(1, severity == "warning").alias("events_warning_24h"),
            count(7).alias("events_total_7d"),
            count(7, kind == "connection_lost").alias("events_connection_lost_7d"),
            count(7, kind == "bloat_exceeds_threshold").alias("events_bloat_threshold_7d"),
            count(7, kind == "security_risk_detected").alias("events_security_risk_7d"),
            F.count(F.lit(1)).alias("events_total_30d"),
        )
    )


QOE = "qoe_composite_latest"
POOR_QOE = 70.0


def qoe_states(snapshots: DataFrame) -> DataFrame:
    """Hourly states of the quality score, written once for the statistics made of them."""
    rows = snapshots.select("device_id", "ts", QOE)
    return partials.written(partials.states(rows, ["device_id"], [QOE], thresholds={QOE: POOR_QOE}), "qoe-states")


def qoe_history(snapshots: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Per device: drops over 10 points in the last day, share below 70 in the last seven."""
    held = qoe_states(snapshots) if held is None else held
    rows = snapshots.where(F.col(QOE).isNotNull()).select("device_id", "ts", QOE)
    week = partials.trailing(
        rows, ["device_id"], [QOE], {"7d": temporal.window_micros("7d")}, thresholds={QOE: POOR_QOE}, held=held
    )
    below = week.select("device_id", (F.col("state.below") / F.col("state.n")).alias("qoe_below_70_pct_7d"))
    return _qoe_drops(rows, held).join(below.hint("merge"), "device_id", "full")


def _qoe_drops(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The states know how many readings the busiest hour has, and when each device was last heard of."""
    busiest = held.agg(F.max(F.col(QOE)["rows"])).first()[0] or 0
    length = partials.HOUR if busiest <= partials.CHUNK_ROWS else partials.chunk_length(rows, ["device_id"])
    ends = held.groupBy("device_id").agg(F.max(F.col(QOE)["last"]).alias("end")).where("end IS NOT NULL")
    drops = temporal.trailing_drops(rows, ["device_id"], QOE, "24h", ends=ends, length=length)
    return drops.withColumnRenamed("drops", "qoe_drops_24h")


def qoe_bundle(snapshots: DataFrame) -> DataFrame:
    """Quality statistics of the trailing windows and ``qoe_history``, from one set of states."""
    held = qoe_states(snapshots)
    stats = temporal.bundle(snapshots, [QOE], names={QOE: "qoe_composite"}, thresholds={QOE: POOR_QOE}, held=held)
    rows = snapshots.where(F.col(QOE).isNotNull()).select("device_id", "ts", QOE)
    named = stats.withColumnRenamed("qoe_composite_below_7d", "qoe_below_70_pct_7d")
    return named.join(_qoe_drops(rows, held).hint("merge"), "device_id", "left")


def ordinal_codes(rows: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values of a column numbered from 0 in sorted order."""
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return row_numbers(distinct, [column], "_code").select(column, (F.col("_code") - 1).cast("double").alias(code))


def sightings(heartbeats: DataFrame) -> DataFrame:
    """First and last time of each (device, model, firmware, subscriber): what heartbeats tell of a device.

    Fixed-size buffers, which Spark hashes; picking a text by time straight from the raw rows would
    sort them.
    """
    return heartbeats.groupBy("device_id", "model", "firmware", "subscriber_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def device_metadata(heartbeats: DataFrame, as_of: str | Column, seen: DataFrame | None = None) -> DataFrame:
    """Model and firmware codes, days since the current firmware and the device first appeared.

    ``heartbeats``: (device_id, ts, model, firmware, subscriber_id); ``seen`` their sightings, if at hand.
    """
    end = _time(as_of)
    seen = sightings(heartbeats) if seen is None else seen
    current = seen.groupBy("device_id").agg(
        F.max_by("model", "last").alias("model"),
        F.max_by("firmware", "last").alias("firmware"),
        F.min("first").alias("device_first"),
    )
    firmware_first = seen.groupBy("device_id", "firmware").agg(F.min("first").alias("firmware_first"))

    def age(column: str) -> Column:
        return F.date_diff(end, F.col(column)).cast("double")

    return (
        current.join(
            firmware_first.select(F.col("device_id").alias("_device"), F.col("firmware").alias("_firmware"), "firmware_first").hint("merge"),
            (F.col("device_id") == F.col("_device")) & F.col("firmware").eqNullSafe(F.col("_firmware")),
        )
        # Devices without a model or firmware stay, without a code.
        .join(ordinal_codes(seen, "model", "model_encoded"), "model", "left")
        .join(ordinal_codes(seen, "firmware", "firmware_encoded"), "firmware", "left")
        .select(
            "device_id",
            "model",
            "firmware",
            "model_encoded",
            "firmware_encoded",
            age("firmware_first").alias("firmware_age_days"),
            age("device_first").alias("device_age_days"),
        )
    )


def device_ages(seen: DataFrame, as_of: str | Column) -> DataFrame:
    """Days since each device was first seen, from any rows (device_id, ts)."""
    return seen.groupBy("device_id").agg(F.date_diff(_time(as_of), F.min("ts")).cast("double").alias("device_age_days"))


def device_owners(heartbeats: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Latest subscriber and first sighting per device."""
    spans = (sightings(heartbeats) if seen is None else seen).where(F.col("subscriber_id").isNotNull())
    return spans.groupBy("device_id").agg(
        F.max_by("subscriber_id", "last").alias("subscriber_id"), F.min("first").alias("first_seen")
    )


def of_subscribers(per_device: DataFrame, as_of: str | Column) -> DataFrame:
    """Subscriber sums of rows (device, subscriber_id, first_seen, qoe_sum, qoe_n, qoe_min, events, tests, ratio)."""
    return per_device.where("subscriber_id IS NOT NULL").groupBy("subscriber_id").agg(
        F.count(F.lit(1)).alias("subscriber_device_count"),
        F.try_divide(F.sum("qoe_sum"), F.sum("qoe_n")).alias("subscriber_avg_qoe_7d"),
        F.min("qoe_min").alias("subscriber_min_qoe_7d"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("subscriber_total_events_30d"),
        (F.coalesce(F.sum("tests"), F.lit(0)) * 7 / F.lit(30.0)).alias("subscriber_speed_test_frequency"),
        F.date_diff(_time(as_of), F.min("first_seen")).alias("subscriber_tenure_days"),
        F.avg("ratio").alias("subscriber_dl_utilization_ratio"),
    )


def of_snapshots(as_of: str | Column) -> list[Column]:
    """What a device's snapshots give to its subscriber: aggregates over (ts, quality, rates)."""
    ts, quality, dl = F.col("ts"), F.col(QOE), F.col("dl_mbps_latest")
    week, month = within(ts, as_of, 7), within(ts, as_of, 30) & dl.isNotNull()
    ratio = F.try_divide(dl, F.nullif(F.col("provisioned_dl_mbps"), F.lit(0.0)))
    return [
        F.sum(F.when(week, quality)).alias("qoe_sum"), F.count(F.when(week, quality)).alias("qoe_n"),
        F.min(F.when(week, quality)).alias("qoe_min"), F.count_if(month).alias("tests"),
        F.max_by(F.when(month, ratio), F.when(month, ts)).alias("ratio"),
    ]


def subscriber_rollup(
    heartbeats: DataFrame,
    qoe: DataFrame,
    events: DataFrame,
    speed_tests: DataFrame,
    as_of: str | Column,
) -> DataFrame:
    """Per subscriber: devices, QoE of 7 days, events of 30 days, speed tests per week, tenure,
    and download rate relative to the provisioned one.

    Inputs: heartbeats (device_id, ts, subscriber_id), qoe (device_id, ts, value), events
    (device_id, ts), speed_tests (device_id, ts, dl, provisioned). Each is reduced to one row per
    device before anything is joined.
    """
    ts = F.col("ts")
    owners = device_owners(heartbeats)
    quality = qoe.where(within(ts, as_of, 7)).groupBy("device_id").agg(
        F.sum("value").alias("qoe_sum"), F.count("value").alias("qoe_n"), F.min("value").alias("qoe_min")
    )
    counts = events.where(within(ts, as_of, 30)).groupBy("device_id").agg(F.count(F.lit(1)).alias("events"))
    tests = speed_tests.where(within(ts, as_of, 30)).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("tests"),
        F.max_by(F.try_divide("dl", F.nullif("provisioned", F.lit(0.0))), "ts").alias("ratio"),
    )
    per_device = owners.join(quality, "device_id", "left").join(counts, "device_id", "left").join(
        tests, "device_id", "left"
    )
    return of_subscribers(per_device, as_of)
