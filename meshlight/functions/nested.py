"""Access to nested struct fields by a dotted path."""

from __future__ import annotations

from pyspark.sql import Column


def at(column: Column, path: str) -> Column:
    for part in path.split("."):
        column = column[part]
    return column
