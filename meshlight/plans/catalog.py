"""Registry of named queries over the driver's tables, each with its oracle SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.session import tuned
from meshlight.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are put before the oracle's final SELECT."""

    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(tuned(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return run

    return add


# ----------------------------------------------------------------------- shared output shapes


def ts_text(column: str | Column) -> Column:
    """Timestamps leave the queries as text, so that both engines print the same microseconds."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def rounded(df: DataFrame, digits: int = 8, *keep: str) -> DataFrame:
    """Round every double column except ``keep``; sums of doubles differ in the last bits."""
    doubles = [n for n, t in df.dtypes if t == "double" and n not in keep]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


# ------------------------------------------------------------------------------- oracle parts

EV = (
    "ev AS (SELECT event_id, ts, 'dev-' || user_id AS device_id, user_id, event_type, value AS v, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
)
AS_OF = f"TIMESTAMP '{T.AS_OF}'"

_EVENT_KIND = "CASE CAST(k % 7 AS INTEGER) " + " ".join(
    f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(T.EVENT_KINDS)
) + " END"
DEVICE_EVENTS = (
    "dev_events AS (SELECT event_id, device_id, ts, CASE event_type WHEN 'error' THEN 'critical' "
    f"WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity, {_EVENT_KIND} AS type FROM ev)"
)
SNAP = "snap AS (SELECT device_id, ts, " + ", ".join(
    f"{T.formula(f)} AS {f}" for f in T.SNAPSHOT_FEATURES
) + " FROM ev)"
FLEET = "fleet AS (SELECT device_id, max(ts) AS ts, " + ", ".join(
    f"arg_max({f}, ts) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in T.SNAPSHOT_FEATURES
) + " FROM snap GROUP BY device_id)"
HEARTBEATS = (
    "beats AS (SELECT device_id, ts, 'M-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS model, "
    "'fw-' || lpad(CAST(day(ts) // 7 AS VARCHAR), 2, '0') AS firmware, c_name AS subscriber_id "
    "FROM ev LEFT JOIN customer ON c_custkey = user_id // 2)"
)
SERIES = (
    "series AS (SELECT device_id, ts, v AS value FROM ev UNION ALL "
    "SELECT 'type-' || event_type, ts, v FROM ev)"
)
