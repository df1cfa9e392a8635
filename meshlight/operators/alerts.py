"""Threshold rules over device features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.functions.rounding import fixed_text
from meshlight.values import ALERT_RULES

Rule = tuple[str, str, str, str, float, str, str]


def fires(operator: str, value: Column, threshold: float) -> Column:
    """The comparison named by ``operator``; false for an unknown name or a missing value."""
    limit = F.lit(float(threshold))
    test = {
        "gt": value > limit,
        "lt": value < limit,
        "gte": value >= limit,
        "lte": value <= limit,
        "eq": value == limit,
    }.get(operator, F.lit(False))
    return F.coalesce(test, F.lit(False))


def evaluate(rows: DataFrame, rules: Sequence[Rule] = ALERT_RULES, keep: Sequence[str] = ("device_id",)) -> DataFrame:
    """One row per fired rule. Works on a batch and on a stream alike: rules are literals, so
    evaluation is a projection without a join or a shuffle."""
    have = set(rows.columns)
    usable = [r for r in rules if r[2] in have]
    checked = [
        F.when(
            fires(operator, F.col(feature).cast("double"), threshold),
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.lit(label).alias("label"),
                F.lit(severity).alias("severity"),
                F.lit(impact).alias("impact"),
                F.lit(feature).alias("feature"),
                F.col(feature).cast("double").alias("value"),
                F.lit(float(threshold)).alias("threshold"),
                F.lit(operator).alias("operator"),
            ),
        )
        for rule, label, feature, operator, threshold, severity, impact in usable
    ]
    fired = rows.select(*keep, F.explode(F.array_compact(F.array(*checked))).alias("alert"))
    return fired.select(*keep, "alert.*")


def alert_text(alerts: DataFrame) -> DataFrame:
    """Add the notification title and text of each alert."""
    text = F.concat(
        F.col("feature"), F.lit("="), fixed_text(F.col("value"), 1), F.lit(" "), F.col("operator"),
        F.lit(" "), F.col("threshold").cast("string"),
    )
    return alerts.withColumns({"title": F.concat(F.lit("Alert: "), F.col("label")), "text": text})
