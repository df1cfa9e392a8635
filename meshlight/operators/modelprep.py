"""Model input: alignment to a feature list, standard scaling, per-feature z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.functions.barrier import settled


def align(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ("device_id",)) -> DataFrame:
    """Exactly the listed features as doubles; a missing column or value is 0."""
    have = set(rows.columns)

    def column(name: str) -> Column:
        if name not in have:
            return F.lit(0.0).alias(name)
        filled = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.when(F.isnan(filled), F.lit(0.0)).otherwise(filled).alias(name)

    return rows.select(*keep, *[column(f) for f in features])


def scaler(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: ``mean`` and ``scale`` structs. The deviation is the population's; a constant
    feature gets scale 1."""

    def spread(name: str) -> Column:
        deviation = F.stddev_pop(name)
        return F.when(deviation > 0, deviation).otherwise(F.lit(1.0)).alias(name)

    return rows.agg(
        F.struct(*[F.avg(f).alias(f) for f in features]).alias("mean"),
        F.struct(*[spread(f) for f in features]).alias("scale"),
    )


def with_scaler(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the single scaler row as a scalar subquery: no join, evaluated once."""
    return rows.withColumn("_stats", stats.select(F.struct("mean", "scale").alias("s")).scalar())


def scaled(rows: DataFrame, stats: DataFrame, features: Sequence[str], keep: Sequence[str] = ("device_id",)) -> DataFrame:
    """Features as z-values (x - mean) / scale."""
    joined = with_scaler(rows, stats)
    mean, scale = F.col("_stats.mean"), F.col("_stats.scale")
    return joined.select(*keep, *[((F.col(f) - mean[f]) / scale[f]).alias(f) for f in features])


def zscores(features: Sequence[str]) -> Column:
    """Array of (name, value, zscore): absolute deviation in scale units, 3 decimals."""
    mean, scale = F.col("_stats.mean"), F.col("_stats.scale")
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("name"),
                F.col(f).alias("value"),
                F.round(F.abs(F.col(f) - mean[f]) / scale[f], 3).alias("zscore"),
            )
            for f in features
        ]
    )


def top_features(rows: DataFrame, stats: DataFrame, features: Sequence[str], n: int = 5) -> DataFrame:
    """Add ``top_features``: the n largest z-scores, ties in feature order.

    The ranking is a sort of a fixed-length array inside the row, so nothing is exploded or
    shuffled. Rows must be aligned to ``features``.
    """
    found = with_scaler(rows, stats).withColumn("_z", zscores(features))
    ranked = F.array_sort(
        F.transform("_z", lambda z, i: F.struct((-z["zscore"]).alias("o"), i.alias("i"), z.alias("z")))
    )
    top = F.transform(F.slice(ranked, 1, n), lambda r: r["z"])
    return settled(found.withColumn("top_features", top).drop("_stats", "_z"))
