"""From anomaly explanations to diagnoses, recommendations, decisions and notifications, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.barrier import settled
from meshlight.functions.rounding import fixed_text
from meshlight.operators import partials
from meshlight.operators.store import page
from meshlight.sources import stored

_REMEDY_FIELDS = ("action", "title", "description", "auto", "impact")


def diagnose(rows: DataFrame) -> DataFrame:
    """Add ``diagnosis`` from top_features and the 2.4 GHz share.

    Crowding on 2.4 GHz comes first. Then the top features are walked in rank order and the first
    that breaks its z-score rule decides; the rule looks at the size of the deviation, so unusually
    strong signal counts like weak. Three features at 1.5 or more make a general degradation.
    """
    top = F.col("top_features")

    def verdict(f: Column) -> Column:
        hit = F.lit(None).cast("string")
        for feature, diagnosis, least in reversed(V.DIAGNOSIS_RULES):
            hit = F.when((f["name"] == feature) & (f["zscore"] >= least), diagnosis).otherwise(hit)
        return hit

    first = F.get(F.array_compact(F.transform(top, verdict)), F.lit(0))
    moderate = F.size(F.filter(top, lambda f: f["zscore"] >= 1.5))
    crowded = F.coalesce(F.col("wifi_pct_2_4ghz") > 0.6, F.lit(False)) if "wifi_pct_2_4ghz" in rows.columns else F.lit(False)
    verdicts = (
        F.when(crowded, "band_congestion")
        .when(first.isNotNull(), first)
        .when(moderate >= 3, "degraded_general")
        .otherwise("none")
    )
    return settled(rows.withColumn("diagnosis", verdicts))


def plan(rows: DataFrame) -> DataFrame:
    """Add action, title, description, auto, impact (null for diagnosis none) and confidence."""
    remedies = F.create_map(
        *[
            x
            for diagnosis, *fields in V.REMEDIES
            for x in (
                F.lit(diagnosis),
                F.struct(*[F.lit(v).alias(n) for n, v in zip(_REMEDY_FIELDS, fields, strict=True)]),
            )
        ]
    )
    found = rows.withColumn("_remedy", F.try_element_at(remedies, F.col("diagnosis")))
    out = found.withColumns({n: F.col(f"_remedy.{n}") for n in _REMEDY_FIELDS})
    confidence = F.when(F.col("action").isNotNull(), F.col("anomaly_score"))
    return settled(out.withColumn("confidence", confidence).drop("_remedy"))


def route(rows: DataFrame, auto_enabled: bool = False) -> DataFrame:
    """Add ``route``: end without an action, execute when automatic, allowed and sure, else escalate.

    ``status`` follows the route; a device without features failed.
    """
    sure = F.col("confidence") >= V.AUTO_CONFIDENCE
    chosen = (
        F.when(F.col("action").isNull(), "end")
        .when(F.col("auto") & F.lit(auto_enabled) & sure, "execute")
        .otherwise("escalate")
    )
    status = (
        F.when(F.size("top_features") == 0, "failed")
        .when(F.col("route") == "execute", "executed")
        .when(F.col("route") == "escalate", "escalated")
        .otherwise(F.when(F.col("diagnosis") == "none", "diagnosed").otherwise("planned"))
    )
    return rows.withColumn("route", chosen).withColumn("status", status)


def flagged(
    scores: DataFrame,
    executions: DataFrame,
    as_of: str,
    threshold: float = V.AGENT_THRESHOLD,
    cooldown_hours: int = V.AGENT_COOLDOWN_HOURS,
    limit: int | None = None,
) -> DataFrame:
    """Devices over the anomaly threshold that no run has touched within the cooldown.

    ``limit`` caps the scanned devices by id, as an option; without it the whole fleet is scanned.
    """
    scanned = scores if limit is None else scores.orderBy("device_id").limit(limit)
    now = F.lit(as_of).cast("timestamp")
    recent = executions.where(
        F.col("completed_at") > now - F.make_dt_interval(F.lit(0), F.lit(cooldown_hours))
    ).select("device_id")
    return scanned.where(F.col("anomaly_score") >= threshold).join(recent, "device_id", "left_anti")


def recommendations(planned: DataFrame, created_at: str) -> DataFrame:
    """Pending recommendations for the escalated rows; ids derive from device, time and action."""
    name, version = V.AGENT_MODEL
    when = F.lit(created_at).cast("timestamp")
    key = F.concat_ws(":", "device_id", F.lit(created_at), "action")
    return planned.where(F.col("route") == "escalate").select(
        F.substring(F.sha2(key, 256), 1, 36).alias("id"),
        "device_id",
        F.col("action").alias("type"),
        "title",
        "description",
        "diagnosis",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("impact", F.lit("low")).alias("impact"),
        F.lit(False).alias("auto_executable"),
        F.lit("pending").alias("status"),
        when.alias("created_at"),
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
    )


def executions(planned: DataFrame, started_at: str) -> DataFrame:
    """Audit rows of one scan. ``auto_executed`` follows the route taken."""
    when = F.lit(started_at).cast("timestamp")
    return planned.select(
        F.substring(F.sha2(F.concat_ws(":", "device_id", F.lit(started_at)), 256), 1, 36).alias("id"),
        "device_id",
        when.alias("started_at"),
        when.alias("completed_at"),
        "status",
        "diagnosis",
        F.col("action").alias("recommended_action"),
        (F.col("route") == "execute").alias("auto_executed"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
    )


def decided(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recommendations with the latest decision of an append-only log applied.

    ``decisions``: (id, decided_at, status, decided_by); an approval also records who and when. Of
    decisions at one time the one last by (status, decided_by) holds.
    """
    return _applied(recs, decisions, "left")


def _applied(recs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """``decided``; as an inner join only the recommendations that a decision names."""
    last = decisions.groupBy("id").agg(F.max(F.struct("decided_at", "status", "decided_by")).alias("_last")).select(
        "id", F.col("_last.status").alias("_status"), F.col("_last.decided_by").alias("_by"), F.col("_last.decided_at").alias("_at")
    )
    approved = F.col("_status") == "approved"
    return (
        recs.join(last, "id", how)
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "executed_at": F.when(approved, F.col("_at")),
                "executed_by": F.when(approved, F.col("_by")),
            }
        )
        .drop("_status", "_by", "_at")
    )


def unknown_decisions(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose recommendation does not exist ("not found")."""
    return decisions.join(recs.select("id"), "id", "left_anti")


def pending(recs: DataFrame, device_id: str | None = None) -> DataFrame:
    """Pending recommendations, surest first, of one device or of all."""
    rows = recs.where(F.col("status") == "pending")
    if device_id is not None:
        rows = rows.where(F.col("device_id") == device_id)
    return rows.orderBy("device_id", F.desc("confidence"), "id")


def verified(runs: DataFrame, scores: DataFrame, length: int | None = None) -> DataFrame:
    """Executions with the first score after the run; verified when it is lower.

    ``runs``: (id, device_id, completed_at, anomaly_score); ``scores``: (device_id, ts, score).
    As-of without a range join: both sides are put on one time line per device and cut into chunks of
    ``length`` microseconds; a run takes the next score of its chunk, or the first score of the next chunk
    that has one. The largest sort is one device's chunk: an hour, cut finer where a device has many
    scores or runs in one.
    """
    points = scores.select("device_id", "ts", F.col("score"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("before"))
    asked = runs.select(
        "device_id", F.col("completed_at").alias("ts"), F.lit(None).cast("double").alias("score"), "id",
        F.col("anomaly_score").alias("before"),
    )
    length = length or partials.chunk_length(points.unionByName(asked), ["device_id"])
    chunk = partials.chunk_start(partials.micros(F.col("ts")), length).alias("_chunk")
    line = points.unionByName(asked).select("*", chunk)
    # A score at the very time of the run is not after it: scores sort before runs.
    inside = Window.partitionBy("device_id", "_chunk").orderBy("ts", F.col("id").isNotNull()).rowsBetween(
        1, Window.unboundedFollowing
    )
    rows = line.withColumn("_next", F.first("score", ignorenulls=True).over(inside))
    first = points.groupBy("device_id", chunk).agg(F.min_by("score", "ts").alias("_first"))
    hours = rows.select("device_id", "_chunk").distinct().join(first, ["device_id", "_chunk"], "left")
    later = Window.partitionBy("device_id").orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    hours = hours.select("device_id", "_chunk", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    after = F.coalesce("_next", "_later")
    return (
        rows.where(F.col("id").isNotNull())
        .join(hours, ["device_id", "_chunk"])
        .select("id", "device_id", F.col("before"), after.alias("after"))
        .withColumn("verified", F.coalesce(F.col("after") < F.col("before"), F.lit(False)))
    )


def run_history(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(runs, [F.desc("started_at"), F.col("id")], limit, offset)


def scan_summary(scores: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Flagged devices, all runs, and devices still cooling down."""
    now = F.lit(as_of).cast("timestamp")
    cooling = F.col("completed_at") > now - F.make_dt_interval(F.lit(0), F.lit(V.AGENT_COOLDOWN_HOURS))
    hot = scores.agg(F.count_if(F.col("anomaly_score") >= V.AGENT_THRESHOLD)).scalar()
    per_device = runs.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max(cooling).alias("cooling")
    )
    return per_device.agg(
        F.coalesce(F.sum("runs"), F.lit(0)).alias("total_runs"),
        F.count_if("cooling").alias("cooldown_devices"),
    ).withColumn("flagged", hot)


def outbox(recs: DataFrame, product: str = "Fleet") -> DataFrame:
    """One row per notification channel of a recommendation, with its subject and text."""
    channels = F.create_map(
        *[x for impact, names in V.IMPACT_CHANNELS.items() for x in (F.lit(impact), F.array(*[F.lit(n) for n in names]).cast("array<string>"))]
    )
    marks = F.create_map(*[F.lit(x) for pair in V.IMPACT_MARKS.items() for x in pair])
    mark = F.coalesce(F.try_element_at(marks, F.col("impact")), F.lit(":white_circle:"))
    share = F.concat(fixed_text(F.col("_percent"), 0), F.lit("%"))
    text = F.concat(
        mark, F.lit(f" *{product} Agent Alert*\nDevice `"), F.col("device_id"),
        F.lit("` needs attention.\n*Diagnosis:* "), F.col("diagnosis"),
        F.lit("\n*Recommendation:* "), F.col("title"),
        F.lit("\n*Confidence:* "), share, F.lit(" | *Impact:* "), F.upper("impact"),
        F.lit("\nReview in the Admin Console."),
    )
    subject = F.concat(F.lit(f"[{product}] Agent Alert: "), F.col("title"), F.lit(" ("), F.col("device_id"), F.lit(")"))
    return settled(recs.withColumn("_percent", F.col("confidence") * 100.0)).select(
        F.col("id").alias("recommendation_id"),
        "device_id",
        "impact",
        F.explode(F.coalesce(F.try_element_at(channels, F.col("impact")), F.array().cast("array<string>"))).alias("channel"),
        subject.alias("subject"),
        text.alias("text"),
    )


# ------------------------------------------------------------------------------------- stored tables


def add_recommendations(spark: SparkSession, path: str, recs: DataFrame) -> None:
    """Add recommendations (id, status, ...) to a stored table; one that is there keeps its state."""
    empty = {"executed_at": "timestamp", "executed_by": "string"}
    stored.append(spark, path, recs.withColumns({n: F.lit(None).cast(t) for n, t in empty.items() if n not in recs.columns}))


def decide(spark: SparkSession, path: str, decisions: DataFrame) -> DataFrame:
    """Apply decisions (id, decided_at, status, decided_by) to stored recommendations; returns those not found.

    Only the rows that a decision names are written again.
    """
    held = stored.read(spark, path)
    named = _applied(held.drop("executed_at", "executed_by"), decisions, "inner")
    stored.upsert(spark, path, named.select(*held.columns))
    return unknown_decisions(stored.read(spark, path), decisions)


def log_runs(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """Add audit rows of agent runs (id, ...) to a stored table."""
    stored.append(spark, path, runs)
