"""Payload schemas, one per message type. Field names are those of the telemetry format."""

_SPEED = "struct<mbps: double, capacityPercent: double, bloatPercent: double, bloatGrade: string, provisionedMbps: double>"
_IMPACT = "struct<name: string, subject: string, detail: string, penalty: double, severity: string, timestamp: string>"
_CATEGORY = f"struct<name: string, score: double, grade: string, weight: double, impactFactors: array<{_IMPACT}>>"

PAYLOADS = {
    "bbst": (
        f"id string, deviceId string, timestamp string, download {_SPEED}, upload {_SPEED}, "
        "latency struct<idleMs: double, downloadMs: double, uploadMs: double, idleJitterMs: double, "
        "downloadJitterMs: double, uploadJitterMs: double>, "
        "server struct<host: string, city: string, country: string, distanceKm: double>, "
        "client struct<ip: string, isp: string, city: string, country: string>, "
        "durationSec double, testType string, anomalyScore double"
    ),
    "qoe": (
        "id string, deviceId string, timestamp string, compositeScore double, compositeGrade string, "
        f"categories struct<wan: {_CATEGORY}, wifi: {_CATEGORY}, mesh: {_CATEGORY}, system: {_CATEGORY}, "
        f"lan: {_CATEGORY}>, satelliteCount bigint, durationSec double, anomalyScore double"
    ),
    "wifi": (
        "clients array<struct<mac: string, hostname: string, band: string, channel: bigint, "
        "channelWidth: bigint, phyRateMbps: double, rssi: double, retransmissionRate: double, mcs: bigint, "
        "nss: bigint, connectedSatellite: string, associatedSince: string, rxBytes: bigint, txBytes: bigint>>, "
        "satellites array<struct<id: string, hostname: string, mac: string, backhaulDlMbps: double, "
        "backhaulUlMbps: double, backhaulBand: string, connectedClients: bigint, hops: bigint, status: string>>, "
        "airtime array<struct<band: string, channel: bigint, txPercent: double, rxPercent: double, "
        "wifiInterferencePercent: double, nonWifiInterferencePercent: double, "
        "totalUtilizationPercent: double, clientCount: bigint>>"
    ),
    "flowstatd_stats": (
        "device_mac string, categories array<struct<masterProtocol: string, appProtocol: string, "
        "category: string, rxBytes: bigint, txBytes: bigint, totalBytes: bigint, activeTimeSec: double, "
        "flowCount: bigint, rxRate: double, txRate: double, maxRiskScore: bigint>>"
    ),
    "flowstatd_hours": (
        "device_mac string, hours array<struct<deviceId: string, mac: string, masterProtocol: string, "
        "appProtocol: string, category: string, hour: string, rxBytes: bigint, txBytes: bigint, "
        "activeTimeSec: double>>"
    ),
    "classifi": (
        "flows array<struct<id: string, deviceId: string, srcIp: string, srcPort: bigint, dstIp: string, "
        "dstPort: bigint, protocol: string, masterProtocol: string, appProtocol: string, category: string, "
        "hostname: string, riskScore: bigint, riskTypes: array<string>, ja4Client: string, "
        "tcpFingerprint: string, osHint: string, protocolStack: array<string>, rxBytes: bigint, "
        "txBytes: bigint, startedAt: string, lastSeenAt: string>>, timestamp string"
    ),
    "events": (
        "id string, deviceId string, type string, severity string, message string, detail string, "
        "timestamp string, acknowledged boolean"
    ),
    "meta": (
        "mac string, model string, firmware string, status string, geo struct<lat: double, lng: double, "
        "address: string, city: string, state: string, zip: string, country: string, serviceArea: string>, "
        "subscriberId string, timestamp string"
    ),
}

MESSAGE = "topic string, payload string, ingest_ts timestamp"
SNAPSHOT = "device_id string, ts timestamp, features map<string,double>"
