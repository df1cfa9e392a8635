"""Raw device files to telemetry payloads: speed-test archives, wireless status, flow statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.nested import at

SPEED_ARCHIVE = (
    "test_id string, starttime double, runtime double, "
    "download struct<mbps: double, pct_utilization: double>, "
    "upload struct<mbps: double, pct_utilization: double>, "
    "latency struct<idle_avg: double, download_avg: double, upload_avg: double, idle_jitter: double, "
    "download_jitter: double, upload_jitter: double>, client struct<ip: string>, "
    "test_options struct<downstream_service_rate: double, upstream_service_rate: double>"
)

WIRELESS_STATUS = (
    "map<string, struct<config: struct<band: string, channel: string>, interfaces: array<struct<assoclist: "
    "array<struct<mac: string, signal: double, rx: struct<rate: double, mcs: bigint, nss: bigint, bytes: bigint>, "
    "tx: struct<bytes: bigint>>>>>>>"
)

FLOW_DEVICES = (
    "devices array<struct<mac: string, name: string, interface: string, rx_bytes: bigint, "
    "tx_bytes: bigint, rx_bps: double, tx_bps: double>>"
)


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def speed_archive(raw: DataFrame) -> DataFrame:
    """Archived speed tests (SPEED_ARCHIVE columns) as decoded ``bbst`` rows, ready for features."""
    start = _or(F.col("starttime"), 0.0)
    whole = start == F.floor(start)
    start_text = F.when(whole, start.cast("bigint").cast("string")).otherwise(start.cast("string"))

    def side(name: str, rate: str) -> Column:
        return F.struct(
            _or(F.col(f"{name}.mbps"), 0.0).alias("mbps"),
            _or(F.col(f"{name}.pct_utilization"), 0.0).alias("capacityPercent"),
            F.lit(0.0).alias("bloatPercent"),
            F.lit("A").alias("bloatGrade"),
            _or(F.col(f"test_options.{rate}"), 0.0).alias("provisionedMbps"),
        )

    latency = F.struct(
        *[
            _or(F.col(f"latency.{src}"), 0.0).alias(dst)
            for src, dst in [
                ("idle_avg", "idleMs"),
                ("download_avg", "downloadMs"),
                ("upload_avg", "uploadMs"),
                ("idle_jitter", "idleJitterMs"),
                ("download_jitter", "downloadJitterMs"),
                ("upload_jitter", "uploadJitterMs"),
            ]
        ]
    )
    device = F.concat(F.lit("bbst-"), _or(F.col("client.ip"), "unknown"))
    ts = F.timestamp_micros(F.round(start * 1e6).cast("bigint"))
    payload = F.struct(
        F.coalesce("test_id", F.concat(F.lit("bbst-"), start_text)).alias("id"),
        device.alias("deviceId"),
        ts.cast("string").alias("timestamp"),
        side("download", "downstream_service_rate").alias("download"),
        side("upload", "upstream_service_rate").alias("upload"),
        latency.alias("latency"),
        _or(F.col("runtime"), 0.0).alias("durationSec"),
        F.lit("scheduled").alias("testType"),
    )
    return raw.select(device.alias("device_id"), ts.alias("ts"), F.lit("bbst").alias("msg_type"), payload.alias("bbst"))


def wireless_payload(status: DataFrame) -> DataFrame:
    """(device_id, status JSON) to one WiFi payload per device message, inside the row.

    Radios without a configuration are skipped; each other radio gives one airtime entry and its
    associated stations become clients.
    """
    radios = F.map_entries(F.from_json("status", WIRELESS_STATUS))
    configured = F.filter(radios, lambda r: at(r, "value.config").isNotNull())
    bands = F.create_map(*[F.lit(x) for pair in V.RAW_BANDS.items() for x in pair])

    def band(r: Column) -> Column:
        return F.coalesce(F.try_element_at(bands, _or(at(r, "value.config.band"), "")), F.lit(V.DEFAULT_BAND))

    def channel(r: Column) -> Column:
        text = _or(at(r, "value.config.channel"), "0")
        return F.when(text.rlike("^[0-9]+$"), text.cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def client(r: Column, a: Column) -> Column:
        return F.struct(
            _or(a["mac"], "").alias("mac"),
            band(r).alias("band"),
            channel(r).alias("channel"),
            F.lit(80).cast("bigint").alias("channelWidth"),
            (_or(at(a, "rx.rate"), 0.0) / 1000.0).alias("phyRateMbps"),
            _or(a["signal"], 0.0).alias("rssi"),
            F.lit(0.0).alias("retransmissionRate"),
            _or(at(a, "rx.mcs"), 0).cast("bigint").alias("mcs"),
            _or(at(a, "rx.nss"), 1).cast("bigint").alias("nss"),
            _or(at(a, "rx.bytes"), 0).cast("bigint").alias("rxBytes"),
            _or(at(a, "tx.bytes"), 0).cast("bigint").alias("txBytes"),
        )

    def stations(r: Column) -> Column:
        lists = F.transform(at(r, "value.interfaces"), lambda i: F.coalesce(i["assoclist"], F.array()))
        return F.transform(F.flatten(F.coalesce(lists, F.array())), lambda a: client(r, a))

    airtime = F.transform(
        configured,
        lambda r: F.struct(
            band(r).alias("band"),
            channel(r).alias("channel"),
            *[
                F.lit(0.0).alias(n)
                for n in (
                    "txPercent",
                    "rxPercent",
                    "wifiInterferencePercent",
                    "nonWifiInterferencePercent",
                    "totalUtilizationPercent",
                )
            ],
            F.lit(0).cast("bigint").alias("clientCount"),
        ),
    )
    clients = F.flatten(F.transform(configured, stations))
    return status.select(
        "device_id",
        "ts",
        clients.alias("clients"),
        airtime.alias("airtime"),
    )


def flow_rows(polls: DataFrame) -> DataFrame:
    """(device_id, ts, flows JSON) to one row per listed device, with its place in the poll."""
    parsed = F.from_json("flows", FLOW_DEVICES)["devices"]
    return polls.select("device_id", "ts", F.posexplode(parsed).alias("place", "d")).select(
        "device_id",
        "ts",
        "place",
        _or(F.col("d.mac"), "").alias("mac"),
        F.col("d.name").alias("name"),
        _or(F.col("d.interface"), "").alias("interface"),
        _or(F.col("d.rx_bytes"), 0).cast("bigint").alias("rx_bytes"),
        _or(F.col("d.tx_bytes"), 0).cast("bigint").alias("tx_bytes"),
        _or(F.col("d.rx_bps"), 0.0).alias("rx_bps"),
        _or(F.col("d.tx_bps"), 0.0).alias("tx_bps"),
    )


def client_traffic(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Traffic payload of the devices of each poll that have a hardware address.

    With ``limit`` only the first so many devices of a poll are published.
    """
    listed = rows if limit is None else rows.where(F.col("place") < limit)
    kept = listed.where(F.col("mac") != "")
    category = F.struct(
        F.lit("IP").alias("masterProtocol"),
        _or(F.col("name"), "unknown").alias("appProtocol"),
        F.lit("General").alias("category"),
        F.col("rx_bytes").alias("rxBytes"),
        F.col("tx_bytes").alias("txBytes"),
        (F.col("rx_bytes") + F.col("tx_bytes")).alias("totalBytes"),
        F.lit(0.0).alias("activeTimeSec"),
        F.lit(1).cast("bigint").alias("flowCount"),
        F.col("rx_bps").alias("rxRate"),
        F.col("tx_bps").alias("txRate"),
        F.lit(0).cast("bigint").alias("maxRiskScore"),
    )
    return kept.select(
        F.regexp_replace("mac", ":", "").alias("device_id"),
        "ts",
        F.struct(F.col("mac").alias("device_mac"), F.array(category).alias("categories")).alias("flowstatd_stats"),
    )


def _radio(interface: Column) -> Column:
    return F.when(interface.contains("6g"), "6GHz").when(interface.contains("5g"), "5GHz").otherwise("2.4GHz")


def mesh_clients(rows: DataFrame) -> DataFrame:
    """Clients reached through a mesh satellite, told by the station part of the interface name."""
    iface = F.col("interface")
    return rows.where(iface.contains(".sta")).select(
        "device_id",
        "ts",
        "mac",
        _or(F.col("name"), "").alias("hostname"),
        _radio(iface).alias("band"),
        F.when(iface.contains("6g"), 160).otherwise(80).alias("channel_width"),
        F.substring_index(iface, ".", 1).alias("satellite"),
        "rx_bytes",
        "tx_bytes",
    )


def mesh_satellites(clients: DataFrame) -> DataFrame:
    """One row per satellite of a poll with the number of clients behind it."""
    named = clients.where(F.col("satellite") != "")
    return (
        named.groupBy("device_id", "ts", "satellite")
        .agg(F.count(F.lit(1)).alias("connected_clients"))
        .withColumn("backhaul_band", F.when(F.col("satellite").contains("6g"), "6GHz").otherwise("5GHz"))
        .withColumn("hops", F.lit(1))
        .withColumn("status", F.lit("online"))
    )
