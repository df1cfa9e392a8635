"""Topic filter and split, JSON decoding, payload checks, quarantine and counters.

One pass over the messages: every payload type is decoded under a condition on the message type, so
a row is parsed once, by its own schema, and nothing is shuffled or scanned again per type.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.barrier import settled
from meshlight.functions.nested import at
from meshlight.sources.schemas import PAYLOADS

_BROKEN = "_broken"
_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _BROKEN,
    "allowSingleQuotes": "false",
}
_SUBTOPIC_TYPES = {"stats": "flowstatd_stats", "category_hours": "flowstatd_hours"}


# ------------------------------------------------------------------------------------- topics


def topic_regex(pattern: str) -> str:
    """Subscription pattern to regular expression: ``+`` is one level, ``#`` the rest (or nothing)."""
    rest = pattern.endswith("/#")
    levels = (pattern[:-2] if rest else pattern).split("/")
    body = "/".join("[^/]*" if level == "+" else re.escape(level) for level in levels)
    return f"^{body}{'(/.*)?' if rest else ''}$"


def subscribed(messages: DataFrame, patterns: Sequence[str] = V.SUBSCRIPTIONS) -> DataFrame:
    """Messages whose topic matches one of the subscription patterns."""
    return messages.where(F.col("topic").rlike("|".join(topic_regex(p) for p in patterns)))


def split_topic(messages: DataFrame) -> DataFrame:
    """Add topic_ok, device_id, msg_type and subtopic; the last three are null for a bad topic."""
    levels = F.split("topic", "/", -1)
    ok = (F.size(levels) >= 3) & (F.get(levels, F.lit(0)) == V.TOPIC_ROOT)
    rest = F.array_join(F.slice(levels, 4, F.greatest(F.size(levels) - 3, F.lit(0))), "/")
    return messages.withColumns(
        {
            "topic_ok": F.coalesce(ok, F.lit(False)),
            "device_id": F.when(ok, F.get(levels, F.lit(1))),
            "msg_type": F.when(ok, F.get(levels, F.lit(2))),
            "subtopic": F.when(ok, rest),
        }
    )


# -------------------------------------------------------------------------------------- checks


def timestamp_of(text: Column) -> Column:
    """ISO text or epoch seconds to a timestamp; null when it is neither.

    Text that begins with a year and a hyphen is no number and not tried as one: a failed try raises an
    exception inside the cast, which costs more than the rest of a check.
    """
    number = F.when(~text.rlike("^[0-9]{4}-"), text.try_cast("double"))
    return F.coalesce(F.timestamp_seconds(number), text.try_cast("timestamp"))


def _one_of(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(value.isin(list(allowed)), F.lit(False))


def _within(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def _every(items: Column, check) -> Column:
    """All items pass; a missing list counts as empty."""
    return F.coalesce(F.forall(items, check), F.lit(True))


def _given(*fields: Column) -> Column:
    present = F.lit(True)
    for field in fields:
        present = present & field.isNotNull()
    return present


def _optional(value: Column, check: Column) -> Column:
    return value.isNull() | check


def _speed_ok(p: Column) -> Column:
    checks = _given(
        p["id"], p["deviceId"], timestamp_of(p["timestamp"]), at(p, "download.mbps"), at(p, "upload.mbps"),
        at(p, "latency.idleMs"), at(p, "latency.downloadMs"), at(p, "latency.uploadMs"),
    )
    for side in ("download", "upload"):
        grade = at(p, f"{side}.bloatGrade")
        checks = checks & _optional(grade, _one_of(grade, V.BLOAT_GRADES))
    return checks & _optional(p["testType"], _one_of(p["testType"], V.TEST_TYPES))


def _impact_ok(f: Column) -> Column:
    return _given(
        f["name"], f["subject"], f["detail"], f["penalty"], timestamp_of(f["timestamp"])
    ) & _one_of(f["severity"], V.IMPACT_SEVERITIES)


def _qoe_ok(p: Column) -> Column:
    checks = (
        _given(p["id"], p["deviceId"], timestamp_of(p["timestamp"]))
        & _within(p["compositeScore"], 0, 100)
        & _one_of(p["compositeGrade"], V.QOE_GRADES)
    )
    for name in V.QOE_CATEGORIES:
        c = at(p, f"categories.{name}")
        checks = (
            checks
            & _one_of(c["name"], V.QOE_CATEGORIES)
            & _within(c["score"], 0, 100)
            & _one_of(c["grade"], V.QOE_GRADES)
            & _within(c["weight"], 0, 1)
            & _every(c["impactFactors"], _impact_ok)
        )
    return checks


def _wifi_ok(p: Column) -> Column:
    def client(c: Column) -> Column:
        return _given(c["mac"], c["channel"]) & _one_of(c["band"], V.BANDS)

    def satellite(s: Column) -> Column:
        return (
            _given(s["id"], s["mac"])
            & _optional(s["backhaulBand"], _one_of(s["backhaulBand"], V.BANDS))
            & _optional(s["status"], _one_of(s["status"], V.DEVICE_STATUSES))
        )

    def airtime(a: Column) -> Column:
        return _given(a["channel"]) & _one_of(a["band"], V.BANDS)

    return _every(p["clients"], client) & _every(p["satellites"], satellite) & _every(p["airtime"], airtime)


def _stats_ok(p: Column) -> Column:
    return _given(p["device_mac"]) & _every(
        p["categories"], lambda c: _given(c["masterProtocol"], c["appProtocol"], c["category"])
    )


def _hours_ok(p: Column) -> Column:
    return _given(p["device_mac"]) & _every(
        p["hours"],
        lambda h: _given(
            h["deviceId"], h["mac"], h["masterProtocol"], h["appProtocol"], h["category"], h["hour"]
        ),
    )


def _flows_ok(p: Column) -> Column:
    def flow(f: Column) -> Column:
        return _given(
            f["id"], f["deviceId"], f["srcIp"], f["srcPort"], f["dstIp"], f["dstPort"]
        ) & _one_of(f["protocol"], V.FLOW_PROTOCOLS)

    when = p["timestamp"]
    return _every(p["flows"], flow) & _optional(when, timestamp_of(when).isNotNull())


def _event_ok(p: Column) -> Column:
    return _given(p["id"], p["deviceId"], p["type"], timestamp_of(p["timestamp"])) & _one_of(
        p["severity"], V.EVENT_SEVERITIES
    )


def _meta_ok(p: Column) -> Column:
    placed = _given(at(p, "geo.lat"), at(p, "geo.lng"))
    return (
        _given(p["mac"], p["model"], p["firmware"], timestamp_of(p["timestamp"]))
        & _one_of(p["status"], V.DEVICE_STATUSES)
        & _optional(p["geo"], placed)
    )


CHECKS = {
    "bbst": _speed_ok,
    "qoe": _qoe_ok,
    "wifi": _wifi_ok,
    "flowstatd_stats": _stats_ok,
    "flowstatd_hours": _hours_ok,
    "classifi": _flows_ok,
    "events": _event_ok,
    "meta": _meta_ok,
}


# -------------------------------------------------------------------------------------- decode


def _payload_kind() -> Column:
    """The payload type to decode by; null when no type fits."""
    plain = [k for k in PAYLOADS if not k.startswith("flowstatd")]
    kind = F.when(F.col("msg_type").isin(plain), F.col("msg_type"))
    for subtopic, name in _SUBTOPIC_TYPES.items():
        kind = kind.when((F.col("msg_type") == "flowstatd") & (F.col("subtopic") == subtopic), F.lit(name))
    return kind


def decode(messages: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Decode and check messages (topic, payload, ingest_ts).

    Adds one struct column per payload type (null unless the row is of that type and valid),
    ``msg_type`` with the two flow-statistics types told apart, the event time ``ts`` (arrival time
    where the payload carries none), and ``reason``: null for a good row, else why it is rejected.
    """
    types = list(types or PAYLOADS)
    rows = split_topic(messages).withColumn("payload", F.col("payload").cast("string"))
    rows = rows.withColumn("_kind", _payload_kind())
    rows = rows.withColumns(
        {
            f"_{t}": F.when(
                F.col("_kind") == t,
                F.from_json("payload", f"{PAYLOADS[t]}, {_BROKEN} string", _JSON_OPTIONS),
            )
            for t in types
        }
    )
    rows = settled(rows)

    malformed = F.expr("try_parse_json(payload)").isNull()
    reason = F.when(~F.col("topic_ok"), F.lit("bad_topic"))
    for t in types:
        p = F.col(f"_{t}")
        failed = p.isNull() | p[_BROKEN].isNotNull() | ~CHECKS[t](p)
        reason = reason.when(
            F.col("_kind") == t,
            F.when(failed, F.when(malformed, F.lit("bad_json")).otherwise(F.lit("failed_check"))),
        )
    if set(types) == set(PAYLOADS):
        reason = (
            reason.when(malformed, F.lit("bad_json"))
            .when(F.col("msg_type") == "flowstatd", F.lit("unknown_subtopic"))
            .otherwise(F.lit("unknown_type"))
        )
    rows = settled(rows.withColumn("reason", reason))

    stamped = [t for t in types if "timestamp string" in PAYLOADS[t]]
    times = [timestamp_of(F.col(f"_{t}.timestamp")) for t in stamped]
    good = F.col("reason").isNull()
    return rows.withColumns(
        {
            **{t: F.when(good, F.col(f"_{t}")) for t in types},
            "ts": F.when(good, F.coalesce(*times, F.col("ingest_ts"))),
            "msg_type": F.when(good, F.coalesce("_kind", "msg_type")).otherwise(F.col("msg_type")),
        }
    ).drop("_kind", *[f"_{t}" for t in types])


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("reason")


def quarantined(decoded: DataFrame) -> DataFrame:
    """Rejected messages with the reason, as received."""
    return decoded.where(F.col("reason").isNotNull()).select(
        "topic", "payload", "ingest_ts", "device_id", "msg_type", "subtopic", "reason"
    )


def counters(decoded: DataFrame) -> DataFrame:
    """Messages and errors: one row per outcome."""
    return decoded.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("messages")
    )
