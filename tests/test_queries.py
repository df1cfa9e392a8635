"""Registered queries against their oracles on the smallest driver tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracles import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
# Long model runs have their own tests; a sample of every operator family is run here.
NAMES = [
    "topic_split", "quarantine", "speed_features", "qoe_features", "wifi_features", "traffic_features", "feature_snapshots",
    "hourly_usage", "speed_archive_import", "wireless_status_import", "mesh_satellites_import", "fleet_latest", "fleet_merged",
    "fleet_latest_of_list", "orders_page", "rolling_stats", "drop_counts", "temporal_bundle", "event_counters", "subscriber_rollup",
    "device_metadata", "top_features", "time_folds", "roc_auc", "category_codes", "risk_list", "alert_texts", "fleet_scan",
    "run_verification", "decided_recommendations", "models_one_per_name", "drift_report", "forecast_summary", "seasonal_forecast",
    "document_chunks", "cosine_search_batch", "context_blocks", "device_prompts", "stream_event_counters", "stream_cooldown", "fleet_health",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    outcome, rows = compare(spark, con, SF_DIR, name)
    assert outcome == "match" and (rows > 0 or name == "risk_list")  # too few devices for a second page


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
