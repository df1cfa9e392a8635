"""Rounding to n digits, ties to even on the exact binary value (what IEEE-correct printf does).

Spark's own ``round`` and ``format_string`` round half up on the shortest decimal text of a double,
so 12.25 prints as 12.3 and 2.675 becomes 2.68. Reports that must read 12.2 and 2.67 use this one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves whose products with a power of ten are exact.
_SPLITTER = 134217729.0


def _product(v: Column, scale: Column) -> Column:
    """v * scale as an exact sum of a double and its rounding error."""
    spread = v * _SPLITTER
    high = spread - (spread - v)
    a, b = high * scale, (v - high) * scale
    near = a + b
    shift = near - a
    error = (a - (near - shift)) + (b - shift)
    return F.named_struct(F.lit("near"), near, F.lit("error"), error, F.lit("v"), v)


def _nearest(p: Column, scale: Column) -> Column:
    # floor() yields a long; values too large for it have no fraction to round anyway.
    small = F.abs(p["v"]) < 1e9
    whole = F.floor(F.when(small, p["near"]).otherwise(F.lit(0.0))).cast("double")
    part = p["near"] - whole
    odd = whole - 2.0 * F.floor(whole / 2.0) == 1.0
    up = (part > 0.5) | ((part == 0.5) & ((p["error"] > 0) | ((p["error"] == 0) & odd)))
    return F.when(small, (whole + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(p["v"])


def round_even(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals.

    The one-element arrays bind intermediate values, so that no expression is written out twice.
    """
    scale = F.lit(float(10**digits))
    parts = F.transform(F.array(value.cast("double")), lambda v: _product(v, scale))
    return F.get(F.transform(parts, lambda p: _nearest(p, scale)), F.lit(0))


def fixed_text(value: Column, digits: int) -> Column:
    """``value`` as text with exactly ``digits`` decimals, ties to even."""
    return F.format_string(f"%.{digits}f", round_even(value, digits))
