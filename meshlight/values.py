"""Names, thresholds, rule rows and texts that results must match exactly."""

# Topic format and subscriptions.
TOPIC_ROOT = "smartos"
SUBSCRIPTIONS = [
    f"{TOPIC_ROOT}/+/bbst",
    f"{TOPIC_ROOT}/+/qoe",
    f"{TOPIC_ROOT}/+/classifi",
    f"{TOPIC_ROOT}/+/flowstatd/#",
    f"{TOPIC_ROOT}/+/wifi",
    f"{TOPIC_ROOT}/+/events",
    f"{TOPIC_ROOT}/+/meta",
]

# Allowed words in payload fields.
QOE_CATEGORIES = ["wan", "wifi", "mesh", "system", "lan"]
QOE_GRADES = ["A", "B", "C", "D", "F"]
BLOAT_GRADES = ["A", "B", "C", "D"]
BANDS = ["2.4GHz", "5GHz", "6GHz"]
DEVICE_STATUSES = ["online", "offline", "degraded"]
TEST_TYPES = ["scheduled", "on_demand", "technician"]
FLOW_PROTOCOLS = ["TCP", "UDP", "OTHER"]
EVENT_SEVERITIES = ["critical", "warning", "info"]
IMPACT_SEVERITIES = ["critical", "major", "minor"]

# Grade codes (an unknown grade counts as 2).
GRADE_CODES = {"A": 0, "B": 1, "C": 2, "D": 3, "F": 4}
UNKNOWN_GRADE_CODE = 2

# Event counters fed by severity and by event type.
SEVERITY_INCREMENTS = {
    "critical": "_event_critical_inc",
    "warning": "_event_warning_inc",
}
TYPE_INCREMENTS = {
    "connection_lost": "_event_connection_lost_inc",
    "bloat_exceeds_threshold": "_event_bloat_threshold_inc",
    "security_risk_detected": "_event_security_risk_inc",
    "high_packet_loss": "_event_packet_loss_inc",
    "qoe_score_drop": "_event_qoe_drop_inc",
}

# Radio band names in raw wireless status.
RAW_BANDS = {"2g": "2.4GHz", "5g": "5GHz", "6g": "6GHz"}
DEFAULT_BAND = "5GHz"

# Model input columns, in order.
ANOMALY_FEATURES = [
    "dl_mbps_latest",
    "ul_mbps_latest",
    "dl_capacity_pct",
    "dl_bloat_pct",
    "latency_idle_ms",
    "jitter_idle_ms",
    "qoe_composite_latest",
    "qoe_wan_latest",
    "qoe_wifi_latest",
    "qoe_mesh_latest",
    "qoe_system_latest",
    "wifi_avg_rssi",
    "wifi_avg_retransmit_rate",
    "wifi_airtime_util_max",
    "mesh_backhaul_min_dl_mbps",
    "traffic_max_risk_score",
    "traffic_total_bytes_1h",
    "events_critical_24h",
    "events_warning_24h",
    "wifi_client_count",
    "mesh_satellite_count",
]
CLUSTER_FEATURES = [
    "dl_mbps_latest",
    "ul_mbps_latest",
    "qoe_composite_latest",
    "wifi_client_count",
    "wifi_avg_rssi",
    "traffic_total_bytes_1h",
    "traffic_streaming_pct",
    "mesh_satellite_count",
    "dl_capacity_pct",
    "events_total_7d",
    "device_age_days",
    "wifi_airtime_util_max",
    "latency_idle_ms",
]
CHURN_CATEGORICAL = ["model_encoded", "firmware_encoded", "qoe_worst_category"]
CHURN_FEATURES = [
    "dl_mbps_latest",
    "ul_mbps_latest",
    "dl_capacity_pct",
    "dl_bloat_pct",
    "latency_idle_ms",
    "jitter_idle_ms",
    "qoe_composite_latest",
    "qoe_wan_latest",
    "qoe_wifi_latest",
    "qoe_mesh_latest",
    "qoe_composite_mean_24h",
    "qoe_composite_std_24h",
    "qoe_composite_min_24h",
    "qoe_composite_trend_7d",
    "qoe_drops_24h",
    "qoe_below_70_pct_7d",
    "qoe_worst_category",
    "wifi_client_count",
    "wifi_avg_rssi",
    "wifi_avg_retransmit_rate",
    "wifi_airtime_util_max",
    "mesh_satellite_count",
    "mesh_backhaul_min_dl_mbps",
    "traffic_total_bytes_1h",
    "traffic_max_risk_score",
    "traffic_streaming_pct",
    "events_critical_24h",
    "events_warning_24h",
    "events_total_7d",
    "events_connection_lost_7d",
    "model_encoded",
    "firmware_encoded",
    "firmware_age_days",
    "device_age_days",
    "provisioned_dl_mbps",
    "subscriber_device_count",
    "subscriber_avg_qoe_7d",
    "subscriber_min_qoe_7d",
    "subscriber_total_events_30d",
    "subscriber_speed_test_frequency",
    "subscriber_tenure_days",
    "subscriber_dl_utilization_ratio",
]

# Churn risk levels as (lower bound, upper bound, name); the upper bound is not included.
RISK_LEVELS = [(0, 25, "low"), (25, 50, "medium"), (50, 75, "high"), (75, 101, "critical")]

# Forecast sizes, in 15-minute steps.
STEP_MINUTES = 15
DAY_STEPS = 96
WEEK_STEPS = 672
MIN_STEPS = 48
FORECAST_WARNINGS = {
    "none": "No QoE history available",
    "short": "Insufficient history for forecasting (need 48+ data points)",
}

# Default alert rules (id, label, feature, operator, threshold, severity, impact).
ALERT_RULES = [
    ("qoe_critical", "QoE Score Critical", "qoe_composite_latest", "lt", 50.0, "critical", "high"),
    ("qoe_warning", "QoE Score Warning", "qoe_composite_latest", "lt", 70.0, "warning", "medium"),
    ("bloat_critical", "Download Bufferbloat Critical", "dl_bloat_pct", "gt", 500.0, "critical", "high"),
    ("bloat_warning", "Download Bufferbloat Warning", "dl_bloat_pct", "gt", 200.0, "warning", "medium"),
    ("latency_critical", "Idle Latency Critical", "latency_idle_ms", "gt", 50.0, "critical", "high"),
    ("wifi_retransmit", "WiFi Retransmission High", "wifi_avg_retransmit_rate", "gt", 15.0, "warning", "medium"),
    ("traffic_risk", "Security Risk Detected", "traffic_max_risk_score", "gt", 100.0, "critical", "high"),
]

# Z-score rules (feature, diagnosis, smallest z-score).
DIAGNOSIS_RULES = [
    ("dl_bloat_pct", "bufferbloat", 2.0),
    ("wifi_avg_rssi", "weak_wifi_signal", 2.0),
    ("wifi_avg_retransmit_rate", "wifi_interference", 2.0),
    ("wifi_airtime_util_max", "wifi_interference", 2.0),
    ("latency_idle_ms", "high_latency", 2.0),
    ("traffic_max_risk_score", "security_risk", 2.0),
]

# Remedies (diagnosis, action, title, description, automatic, impact).
REMEDIES = [
    (
        "bufferbloat",
        "enable_sqm",
        "Enable SQM to reduce bufferbloat",
        "Device shows elevated bufferbloat. Enabling Smart Queue Management will reduce latency under load.",
        True,
        "high",
    ),
    (
        "weak_wifi_signal",
        "mesh_ap_add",
        "Add mesh satellite for better coverage",
        "Weak WiFi signal detected. Adding a mesh satellite near affected clients will improve coverage.",
        False,
        "high",
    ),
    (
        "wifi_interference",
        "band_steering",
        "Enable band steering to reduce interference",
        "High WiFi interference or retransmission rate. Band steering will move clients to less congested bands.",
        True,
        "medium",
    ),
    (
        "band_congestion",
        "band_steering",
        "Enable band steering for 5/6GHz migration",
        "Over 60% of clients on 2.4GHz. Band steering will move capable clients to faster 5/6GHz bands.",
        True,
        "medium",
    ),
    (
        "high_latency",
        "firmware_upgrade",
        "Upgrade firmware to improve latency",
        "Elevated idle latency detected. A firmware upgrade may resolve known latency issues.",
        False,
        "medium",
    ),
    (
        "security_risk",
        "firmware_upgrade",
        "Upgrade firmware to address security risks",
        "High nDPI risk scores detected in traffic flows. Firmware upgrade includes security patches.",
        False,
        "high",
    ),
    (
        "degraded_general",
        "service_tier_change",
        "Review service tier alignment",
        "General performance degradation detected across multiple metrics. Service tier may need adjustment.",
        False,
        "low",
    ),
]

# Agent limits.
AGENT_THRESHOLD = 0.5
AGENT_COOLDOWN_HOURS = 4
AUTO_CONFIDENCE = 0.8
AGENT_MODEL = ("agent_remediation", "2.0.0")

# Notification channels per impact.
IMPACT_CHANNELS = {
    "critical": ["email", "slack", "webhook"],
    "high": ["email", "slack"],
    "medium": ["slack"],
    "low": [],
}
IMPACT_MARKS = {
    "high": ":red_circle:",
    "medium": ":large_orange_circle:",
    "low": ":white_circle:",
}

# Text retrieval.
CHUNK_CHARS = 512
TOP_K = 5
NO_CONTEXT = "No relevant documentation found."
NO_FLEET = "No fleet data available for analysis."
CONTEXT_SEPARATOR = "\n\n---\n\n"

# Prompt texts with %-style slots.
SYSTEM_PROMPT = (
    "You are an expert ISP network technician assistant for %s router fleets. "
    "You analyze telemetry data (QoE scores, speed tests, WiFi metrics, DPI traffic, events) "
    "to diagnose issues and explain them clearly. Be concise and actionable. "
    "When referencing metrics, include the actual values."
)

FLEET_PROMPT = """Summarize the fleet health for the past 24 hours based on the following telemetry data.
Include: overall health assessment, top issues, devices needing attention, and recommended actions.
Keep it under 200 words.

Fleet Data:
%s

Summary:"""
DEVICE_PROMPT = """Explain why device %s is showing performance issues.

Device Metrics:
- Anomaly Score: %.2f/1.0 (higher = more anomalous)
- Churn Risk: %.0f/100
- QoE Score: %.0f/100
- Download: %.0f Mbps
- Upload: %.0f Mbps
- Latency: %.1f ms

Top Contributing Anomaly Features:
%s

Relevant Context:
%s

Provide a clear diagnosis in 2-3 sentences, then list 1-3 specific recommended actions:"""
QUESTION_PROMPT = """Answer the technician's question using the provided context.
If the context doesn't contain enough information, say so.
Be specific and reference actual device IDs, metrics, and values when available.

Context:
%s

Question: %s

Answer:"""

# Words for a segment's means, by comparison and bound; of each measure the first that holds.
SEGMENT_WORDS = [
    ("qoe", "ge", 85, "High-QoE"),
    ("qoe", "lt", 60, "Low-QoE"),
    ("dl", "ge", 500, "High-Speed"),
    ("dl", "lt", 100, "Low-Speed"),
    ("clients", "ge", 15, "Heavy-Use"),
    ("clients", "le", 3, "Light-Use"),
    ("streaming", "gt", 0.5, "Streamers"),
]
