"""Drift of feature distributions between a reference and a current sample."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.operators.ordering import cumulative, quantiles_of_ranked
from meshlight.session import written

BINS = 10
PSI_HIGH, PSI_MODERATE = 0.25, 0.10
KS_MIN_ROWS = 5


def long_form(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) rows of a wide table; nulls are dropped."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(F.inline(pairs)).where(F.col("value").isNotNull())


def both(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct (feature, value) with the number of reference and current rows at the value and below
    it, as a written table that both tests read.

    The only exchange that sees raw rows is the count, which follows a map-side combine.
    """
    marked = reference.withColumn("ref", F.lit(1)).withColumn("cur", F.lit(0)).unionByName(
        current.withColumn("ref", F.lit(0)).withColumn("cur", F.lit(1))
    )
    counts = marked.groupBy("feature", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    ranked = cumulative(written(counts, "drift-counts"), "value", ["ref", "cur"], ["feature"])
    return written(ranked, "drift-ranks")


def psi(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per feature from ``both()`` counts.

    Edges are the distinct interpolated quantiles of the reference. Bins are half open, the last is
    closed; current values outside the edges fall in no bin but count in the total. Shares are
    smoothed by one row per nominal bin. No reference, no current rows or a single edge give 0.
    """
    deciles = quantiles_of_ranked(counts, "value", [i / bins for i in range(bins + 1)], ["feature"], "ref")
    edges = deciles.where("total > 0").select("feature", F.array_distinct("quantiles").alias("edges"))
    # One row per feature: bounded by the schema, not by the data.
    placed = counts.join(F.broadcast(edges), "feature")
    last = F.size("edges")
    inner = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    bin_ = F.when(F.col("value") == F.element_at("edges", -1), last - 1).otherwise(inner)
    inside = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    per_bin = placed.groupBy(
        "feature", F.size("edges").alias("n_edges"), F.when(inside, bin_).otherwise(0).alias("bin")
    ).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    # A bin can hold no row of either sample only if edges enclose nothing, so bins are completed.
    grouped = per_bin.groupBy("feature", "n_edges").agg(
        F.sum("ref").alias("ref_total"),
        F.sum("cur").alias("cur_total"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("ref", "cur")))).alias("bins"),
    )

    def term(b: Column) -> Column:
        held = F.try_element_at("bins", b)
        r = (F.coalesce(held["ref"], F.lit(0)) + 1) / (F.col("ref_total") + bins)
        c = (F.coalesce(held["cur"], F.lit(0)) + 1) / (F.col("cur_total") + bins)
        return (c - r) * F.ln(c / r)

    terms = F.transform(F.sequence(F.lit(1), F.col("n_edges") - 1), term)
    total = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)
    usable = (F.col("n_edges") >= 2) & (F.col("ref_total") > 0) & (F.col("cur_total") > 0)
    found = grouped.select("feature", F.when(usable, total).otherwise(0.0).alias("psi"))
    # A feature without reference rows has no edges at all.
    named = counts.select("feature").distinct().join(found, "feature", "left")
    return named.select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _ks_tail(statistic: Column, effective: Column) -> Column:
    """Two-sided p-value from the asymptotic distribution: 2 * sum (-1)^(j-1) exp(-2 j^2 x^2),
    where x^2 is ``effective`` times the squared statistic."""
    square = effective * statistic * statistic

    def series(terms: int, term) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda j: term(j.cast("double")))
        return F.aggregate(each, F.lit(0.0), lambda total, x: total + x)

    alternating = 2.0 * series(100, lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * square))
    # The alternating series converges too slowly near 0; there the dual (theta) series is used.
    dual = series(20, lambda j: F.exp(-(2 * j - 1) * (2 * j - 1) * math.pi**2 / (8.0 * square)))
    small = 1.0 - F.lit(math.sqrt(2.0 * math.pi)) / F.sqrt(square) * dual
    tail = F.when(square < 1e-16, F.lit(1.0)).when(square < 0.25, small).otherwise(alternating)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))


def ks(counts: DataFrame, significance: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, p-value and decision per feature.

    Fewer than five rows on either side give (0, 1, false). The largest gap between the two
    distribution functions is taken over distinct values.
    """
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    ranked = counts.join(F.broadcast(totals), "feature")  # one row per feature
    gap = F.abs(
        F.try_divide(F.col("ref_before") + F.col("ref"), F.col("n_ref"))
        - F.try_divide(F.col("cur_before") + F.col("cur"), F.col("n_cur"))
    )
    found = ranked.groupBy("feature", "n_ref", "n_cur").agg(F.max(gap).alias("gap"))
    enough = (F.col("n_ref") >= KS_MIN_ROWS) & (F.col("n_cur") >= KS_MIN_ROWS)
    # In doubles: the product of two counts leaves the range of a long.
    n_ref, n_cur = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    effective = n_ref / (n_ref + n_cur) * n_cur
    scored = found.select(
        "feature",
        F.when(enough, F.col("gap")).otherwise(0.0).alias("ks_statistic"),
        enough.alias("_enough"),
        effective.alias("_effective"),
    )
    tail = F.when(F.col("_enough"), _ks_tail(F.col("ks_statistic"), F.col("_effective"))).otherwise(1.0)
    return scored.select("feature", "ks_statistic", tail.alias("ks_p_value")).withColumn(
        "ks_drifted", F.col("ks_p_value") < significance
    )


def report(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI and KS per feature that both samples have, with the verdict and its severity."""
    shared = [f for f in features if f in reference.columns and f in current.columns]
    counts = both(long_form(reference, shared), long_form(current, shared))
    joined = psi(counts).join(ks(counts), "feature")
    value = F.col("psi")
    return joined.select(
        "feature",
        F.round(value, 4).alias("psi"),
        F.round("ks_statistic", 4).alias("ks_statistic"),
        F.round("ks_p_value", 4).alias("ks_p_value"),
        ((value > PSI_HIGH) | F.col("ks_drifted")).alias("is_drifted"),
        F.when(value > PSI_HIGH, "high").when(value > PSI_MODERATE, "moderate").otherwise("low").alias("severity"),
    )


# ------------------------------------------------------------------------------------- daily sketches

SKETCH_K = 800  # accuracy: ranks are off by about 0.4 %


def daily_sketches(rows: DataFrame, features: Sequence[str], ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(feature, day, sketch): a mergeable quantile sketch of each feature's values of each day.

    Some kilobytes a feature and day, whatever the number of rows, from one aggregation with map-side combine.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = rows.select(F.to_date(ts).alias("day"), F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("feature", "day").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def sketched_psi(sketches: DataFrame, reference: Column, current: Column, bins: int = BINS) -> DataFrame:
    """(feature, reference_rows, current_rows, psi) between two spans of days, from their sketches alone.

    ``reference`` and ``current`` are conditions on ``day``. As ``psi``, with quantiles and counts as the sketches
    know them; a feature without rows in a span, or with a single edge, has 0.
    """
    side = {"r": reference, "c": current}
    both = None
    for name, days in side.items():
        one = sketches.where(days).groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias(name))
        both = one if both is None else both.join(one, "feature", "full")
    named = sketches.select("feature").distinct().join(both, "feature", "left")
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("r", F.lit(i / bins)) for i in range(bins + 1)])
    edges = F.array_sort(F.array_distinct(quantiles))
    rows = written(named.select(
        "feature", "r", "c", F.when(F.col("r").isNotNull() & F.col("c").isNotNull(), edges).alias("edges"),
        *[F.coalesce(F.when(F.col(n).isNotNull(), F.kll_sketch_get_n_double(n)), F.lit(0)).alias(f"n_{n}") for n in side],
    ), "merged-sketches")
    last = F.size("edges") - 1
    # A sketch is asked about literals only: the edges of each feature, which the schema bounds.
    known = {r["feature"]: r["edges"] for r in rows.where("edges IS NOT NULL").select("feature", "edges").collect()}

    def below(name: str) -> Column:
        """Values below each edge; up to it for the last edge, whose bin is closed."""
        found = F.lit(None).cast("array<double>")
        for feature, own in known.items():
            asked = [e if i == len(own) - 1 else math.nextafter(e, -math.inf) for i, e in enumerate(own)]
            ranks = F.array(*[F.round(F.col(f"n_{name}") * F.kll_sketch_get_rank_double(name, F.lit(e))) for e in asked])
            found = F.when(F.col("feature") == feature, ranks).otherwise(found)
        return found

    rows = rows.withColumns({f"b_{n}": below(n) for n in side})

    def term(i: Column) -> Column:
        share = {n: (F.get(f"b_{n}", i) - F.get(f"b_{n}", i - 1) + 1) / (F.col(f"n_{n}") + bins) for n in side}
        return (share["c"] - share["r"]) * F.ln(share["c"] / share["r"])

    total = F.aggregate(F.transform(F.sequence(F.lit(1), last), term), F.lit(0.0), lambda t, x: t + x)
    return rows.select(
        "feature", F.col("n_r").alias("reference_rows"), F.col("n_c").alias("current_rows"),
        F.when(F.col("edges").isNotNull() & (last >= 1), total).otherwise(0.0).alias("psi"),
    )
