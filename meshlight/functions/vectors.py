"""Vector arithmetic on ``array<float|double>`` columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(
        vector, lambda x: F.when(length > 0, F.try_divide(x.cast("double"), length)).otherwise(x.cast("double"))
    )
