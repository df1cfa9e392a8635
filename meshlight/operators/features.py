"""Feature extraction from decoded payloads: pure projections over nested arrays, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.nested import at


def _or(value: Column, default: float) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(default)))



def _total(array: Column, value) -> Column:
    return F.coalesce(
        F.aggregate(F.transform(array, value), F.lit(0.0), lambda total, x: total + x), F.lit(0.0)
    )


def _count(array: Column, condition) -> Column:
    return F.greatest(F.size(F.filter(array, condition)), F.lit(0)).cast("double")


def _length(array: Column) -> Column:
    return F.greatest(F.size(array), F.lit(0)).cast("double")


def _largest(array: Column, value) -> Column:
    return F.coalesce(F.array_max(F.transform(array, value)), F.lit(0.0))


def _smallest(array: Column, value) -> Column:
    return F.coalesce(F.array_min(F.transform(array, value)), F.lit(0.0))


def _grade(grade: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in V.GRADE_CODES.items() for x in pair])
    code = F.try_element_at(codes, F.coalesce(grade, F.lit("A")))
    return F.coalesce(code, F.lit(V.UNKNOWN_GRADE_CODE)).cast("double")


def speed(p: Column) -> dict[str, Column]:
    """Speed test: rates, latencies, and latency growth under load relative to idle."""
    idle_raw = at(p, "latency.idleMs")
    idle = F.greatest(idle_raw, F.lit(0.1))

    def bloat(loaded: Column) -> Column:
        return F.greatest((loaded - idle) / idle * 100.0, F.lit(0.0))

    return {
        "dl_mbps_latest": at(p, "download.mbps"),
        "ul_mbps_latest": at(p, "upload.mbps"),
        "dl_capacity_pct": _or(at(p, "download.capacityPercent"), 0),
        "ul_capacity_pct": _or(at(p, "upload.capacityPercent"), 0),
        "dl_bloat_pct": bloat(at(p, "latency.downloadMs")),
        "ul_bloat_pct": bloat(at(p, "latency.uploadMs")),
        "latency_idle_ms": idle_raw,
        "latency_dl_ms": at(p, "latency.downloadMs"),
        "latency_ul_ms": at(p, "latency.uploadMs"),
        "jitter_idle_ms": _or(at(p, "latency.idleJitterMs"), 0),
        "jitter_dl_ms": _or(at(p, "latency.downloadJitterMs"), 0),
        "bloat_grade_dl": _grade(at(p, "download.bloatGrade")),
        "bloat_grade_ul": _grade(at(p, "upload.bloatGrade")),
        "provisioned_dl_mbps": _or(at(p, "download.provisionedMbps"), 0),
        "provisioned_ul_mbps": _or(at(p, "upload.provisionedMbps"), 0),
        "test_duration_sec": _or(p["durationSec"], 0),
    }


def qoe(p: Column) -> dict[str, Column]:
    """Quality scores; the worst category is the first lowest one in category order."""
    parts = [at(p, f"categories.{name}") for name in V.QOE_CATEGORIES]
    lowest = F.least(*[c["score"] for c in parts])
    worst = F.lit(len(parts) - 1)
    for code in reversed(range(len(parts) - 1)):
        worst = F.when(parts[code]["score"] == lowest, F.lit(code)).otherwise(worst)
    impacts = sum((_length(c["impactFactors"]) for c in parts), F.lit(0.0))
    penalty = sum((_total(c["impactFactors"], lambda f: f["penalty"]) for c in parts), F.lit(0.0))
    return {
        "qoe_composite_latest": p["compositeScore"],
        **{f"qoe_{name}_latest": c["score"] for name, c in zip(V.QOE_CATEGORIES, parts, strict=True)},
        "qoe_worst_category": worst,
        "qoe_impact_count": impacts,
        "qoe_total_penalty": penalty,
        "qoe_satellite_count": _or(p["satelliteCount"], 0),
    }


def wifi(p: Column) -> dict[str, Column]:
    """Client signal and band shares, airtime load, mesh health; zero where a list is empty."""
    clients, satellites, airtime = p["clients"], p["satellites"], p["airtime"]
    n = _length(clients)

    def share(x: Column) -> Column:
        return F.coalesce(F.try_divide(x, n), F.lit(0.0))

    def rssi(c: Column) -> Column:
        return _or(c["rssi"], 0)

    def retransmit(c: Column) -> Column:
        return _or(c["retransmissionRate"], 0)

    def on_band(name: str) -> Column:
        return share(_count(clients, lambda c: c["band"] == name))

    return {
        "wifi_client_count": n,
        "wifi_avg_rssi": share(_total(clients, rssi)),
        "wifi_min_rssi": _smallest(clients, rssi),
        "wifi_avg_retransmit_rate": share(_total(clients, retransmit)),
        "wifi_max_retransmit_rate": _largest(clients, retransmit),
        "wifi_pct_2_4ghz": on_band("2.4GHz"),
        "wifi_pct_5ghz": on_band("5GHz"),
        "wifi_pct_6ghz": on_band("6GHz"),
        "wifi_airtime_util_max": _largest(airtime, lambda a: _or(a["totalUtilizationPercent"], 0)),
        "wifi_interference_max": _largest(
            airtime,
            lambda a: _or(a["wifiInterferencePercent"], 0) + _or(a["nonWifiInterferencePercent"], 0),
        ),
        "mesh_satellite_count": _length(satellites),
        "mesh_satellite_offline_count": _count(satellites, lambda s: s["status"] == "offline"),
        "mesh_backhaul_min_dl_mbps": _smallest(satellites, lambda s: _or(s["backhaulDlMbps"], 0)),
        "mesh_max_hops": _largest(satellites, lambda s: _or(s["hops"], 1)),
    }


def traffic(p: Column) -> dict[str, Column]:
    """Traffic totals and the byte share of three categories."""
    rows = p["categories"]

    def volume(c: Column) -> Column:
        return _or(c["totalBytes"], 0)

    total = _total(rows, volume)

    def share(category: str) -> Column:
        part = _total(F.filter(rows, lambda c: c["category"] == category), volume)
        return part / F.greatest(total, F.lit(1.0))

    return {
        "traffic_total_bytes_1h": total,
        "traffic_flow_count_1h": _total(rows, lambda c: _or(c["flowCount"], 0)),
        "traffic_max_risk_score": _largest(rows, lambda c: _or(c["maxRiskScore"], 0)),
        "traffic_streaming_pct": share("Streaming"),
        "traffic_gaming_pct": share("Gaming"),
        "traffic_voip_pct": share("VoIP"),
    }


def flow_risk(p: Column) -> dict[str, Column]:
    flows = p["flows"]
    return {
        "traffic_high_risk_flow_count": _count(flows, lambda f: _or(f["riskScore"], 0) > 50),
        "traffic_max_risk_score": _largest(flows, lambda f: _or(f["riskScore"], 0)),
    }


def event_increments(p: Column) -> dict[str, Column]:
    """Counter increments of one event; a counter the event does not touch is null."""
    out = {name: F.when(p["severity"] == word, 1.0) for word, name in V.SEVERITY_INCREMENTS.items()}
    out |= {name: F.when(p["type"] == word, 1.0) for word, name in V.TYPE_INCREMENTS.items()}
    return out


# Payload types that yield features. Heartbeats and hourly usage yield none; they feed the
# device and subscriber tables and hourly_usage().
EXTRACTORS = {
    "bbst": speed,
    "qoe": qoe,
    "wifi": wifi,
    "flowstatd_stats": traffic,
    "classifi": flow_risk,
    "events": event_increments,
}


def feature_columns(decoded: DataFrame, msg_type: str) -> DataFrame:
    """Features of one message type as real columns."""
    rows = decoded.where(F.col(msg_type).isNotNull())
    columns = EXTRACTORS[msg_type](F.col(msg_type))
    return rows.select("device_id", "ts", *[c.cast("double").alias(n) for n, c in columns.items()])


def _as_map(features: dict[str, Column]) -> Column:
    pairs = [x for name, c in features.items() for x in (F.lit(name), c.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def snapshots(decoded: DataFrame) -> DataFrame:
    """Feature snapshots (device_id, ts, msg_type, features) of all accepted messages, in one pass.

    Messages without features (heartbeats, events that touch no counter) give no row.
    """
    features = None
    for msg_type, extract in EXTRACTORS.items():
        p = F.col(msg_type)
        built = _as_map(extract(p))
        features = F.when(p.isNotNull(), built) if features is None else features.when(p.isNotNull(), built)
    some = F.filter(F.array(features), lambda f: F.size(f) > 0)
    return decoded.select("device_id", "ts", "msg_type", F.explode(some).alias("features"))


def hourly_usage(decoded: DataFrame) -> DataFrame:
    """Bytes and active time per device, traffic category and hour."""
    p = F.col("flowstatd_hours")
    rows = decoded.where(p.isNotNull()).select("device_id", F.explode(p["hours"]).alias("h"))
    return rows.groupBy("device_id", F.col("h.category").alias("category"), F.col("h.hour").alias("hour")).agg(
        F.sum(_or(F.col("h.rxBytes"), 0)).alias("rx_bytes"),
        F.sum(_or(F.col("h.txBytes"), 0)).alias("tx_bytes"),
        F.sum(_or(F.col("h.activeTimeSec"), 0)).alias("active_sec"),
    )
