"""Keeps the optimizer from copying costly expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a one-row generator, which no filter or projection is moved through.

    Without it a filter on a derived column copies the column's expression into the filter once per
    reference, and nested derivations multiply.
    """
    return rows.select(F.inline(F.array(F.struct("*"))))
