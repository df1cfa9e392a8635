"""Whole-table order statistics without a one-task sort.

A window without a partition key sorts the whole table in one task. Here the table is cut into
ranges of the sort key first; each range is ranked on its own and shifted by the totals of the
ranges before it. Range edges come from the keys whose hashes fall below a threshold, so they depend
on the data alone: a task that is run again after a lost executor cuts the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight.session import written

# Sample keys per range: enough to keep ranges within about a third of their mean size.
KEYS_PER_RANGE = 16
_HASHES = 1 << 30


def _ranges(df: DataFrame) -> int:
    """A few ranges per shuffle partition, so that hashing spreads them evenly."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _at_most(edges: Column, key: Column, most: int) -> Column:
    """How many of the at most ``most`` sorted edges are at most ``key``: by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    # Beyond the last edge there is null, which is not at most the key.
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at)
    )


def with_range(df: DataFrame, keys: Sequence[str], ranges: int | None = None, column: str = "_range") -> DataFrame:
    """Add the number of the key range each row falls in (0 for the lowest keys).

    About KEYS_PER_RANGE keys a range are gathered for the edges, whatever the size of the table: a
    scan keeps only keys below the hash threshold, which follows from the number of rows.
    """
    ranges = ranges or _ranges(df)
    key = F.struct(*[F.col(k) for k in keys])
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    below = F.lit(float(_HASHES * KEYS_PER_RANGE * ranges)) / F.greatest(rows, F.lit(1))
    sample = df.select(key.alias("_key")).where(F.pmod(F.xxhash64("_key"), F.lit(_HASHES)) < below)
    sorted_keys = sample.agg(F.sort_array(F.collect_set("_key")).alias("s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / F.lit(ranges))).cast("int")
    edges = sorted_keys.select(
        F.filter("s", lambda k, i: (i > 0) & (i % step == 0)).alias("e")
    ).scalar()
    return (
        df.withColumn("_edges", edges)
        # Never null, or a join on it would push a null check, edges and all, down to the scan.
        .withColumn(column, F.coalesce(_at_most(F.col("_edges"), key, ranges), F.lit(0)))
        .drop("_edges")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], column: str = "row_number") -> DataFrame:
    """1-based position of every row in the order of ``keys`` over the whole table."""
    ranged = with_range(df, keys)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_range").orderBy(*keys)
    return (
        ranged.withColumn("_at", F.row_number().over(local))
        .join(offsets, "_range")  # one row per range
        .withColumn(column, (F.col("_at") + F.col("_before")).cast("long"))
        .drop("_range", "_at", "_before")
    )


def cumulative(
    df: DataFrame, value: str, counts: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<count>_before`` for each count: its sum over smaller values of the same group.

    ``df`` holds one row per (group, value), as left by an aggregation, so that a value shared by a
    third of the table is one row here. It is read three times (edges, range totals, rows), so the
    callers pass a written table.
    """
    by = list(by)
    ranged = with_range(df, [*by, value])
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in counts]
    )
    local = (
        Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    for c in counts:
        ranged = ranged.withColumn(f"_w_{c}", F.coalesce(F.sum(c).over(local), F.lit(0)))
    joined = ranged.join(offsets, [*by, "_range"])
    for c in counts:
        joined = joined.withColumn(f"{c}_before", F.col(f"_w_{c}") + F.col(f"_o_{c}"))
    return joined.drop("_range", *[f"_w_{c}" for c in counts], *[f"_o_{c}" for c in counts])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **weights: Column) -> DataFrame:
    """One row per distinct value (and group) with ``n`` and any extra weighted counts."""
    extra = [F.sum(w).alias(name) for name, w in weights.items()]
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation: columns (group, total, quantiles array)."""
    by = list(by)
    present = df.where(F.col(value).isNotNull())
    counted = written(value_counts(present, value, by), "value-counts")
    return quantiles_of_ranked(cumulative(counted, value, ["n"], by), value, probabilities, by)


def quantiles_of_ranked(
    ranked: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), count: str = "n"
) -> DataFrame:
    """Quantiles from cumulative() output, for the rows counted in ``count`` (zero is allowed)."""
    by = list(by)
    n, before = F.col(count), F.col(f"{count}_before")
    totals = ranked.groupBy(*by).agg(F.sum(count).alias("total"))
    joined = ranked.join(totals, by) if by else ranked.withColumn("total", totals.select("total").scalar())

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < before + n), F.col(value)))

    picks = []
    for i, p in enumerate(probabilities):
        low = F.floor(F.lit(p) * (F.col("total") - 1))
        picks += [at(low).alias(f"_lo{i}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"_hi{i}")]
    picked = joined.groupBy(*by, "total").agg(*picks)

    def between(i: int, p: float) -> Column:
        exact = F.lit(p) * (F.col("total") - 1)
        part = exact - F.floor(exact)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # Interpolate from the nearer end, so that the result is monotone in p.
        return F.when(part >= 0.5, high - (high - low) * (1 - part)).otherwise(low + (high - low) * part)

    return picked.select(
        *by, "total", F.array(*[between(i, p) for i, p in enumerate(probabilities)]).alias("quantiles")
    )


def neighbours(df: DataFrame, value: str) -> DataFrame:
    """Add ``previous`` and ``next``: the adjacent values in sorted order of distinct ``value``s."""
    ranged = with_range(df, [value])
    local = Window.partitionBy("_range").orderBy(value)
    across = Window.orderBy("_range")
    ends = ranged.groupBy("_range").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    ends = ends.select(
        "_range",
        F.lag("_last").over(across).alias("_left"),
        F.lead("_first").over(across).alias("_right"),
    )
    return (
        ranged.withColumn("_p", F.lag(value).over(local))
        .withColumn("_n", F.lead(value).over(local))
        .join(ends, "_range")  # one row per range
        .withColumn("previous", F.coalesce("_p", "_left"))
        .withColumn("next", F.coalesce("_n", "_right"))
        .drop("_range", "_p", "_n", "_left", "_right")
    )
