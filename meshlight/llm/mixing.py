"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``MAX_RATE`` that give each source its target number of
words, the balanced ones are closest to 1 in relative entropy. They are tilted exponentially,
min(MAX_RATE, exp(lambda * size / mean size)), with one multiplier per source: the solution of the
convex dual, found by Newton steps inside a bracket. Each step is one aggregation over the counts of
(source, size), all that the dual depends on. Rates are rounded to whole copies by comparing their
fraction with a hash of the row; a threshold per source, found on histograms, brings the copies'
words to the target. Only DataFrame expressions are used; sources stay in tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meshlight.llm.batches import text_of, without
from meshlight.operators.ordering import row_numbers
from meshlight.session import discard, written, written_at

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3.0
BINS = 1024
LEVELS = 3
MOVES = 3  # rows of a source that change sides after rounding
# A source's words miss its target by at most this part before rounding.
TOLERANCE = 1e-9
_EXACT = "decimal(38,6)"  # sums that do not depend on the order of their terms


def size_of(text: str) -> Column:
    """Number of words of the whole text; a null text has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def targets(sized: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) for rows with ``size``.

    Sources in code point order, null last, take the weights in turn and share all words by them. A
    target stops at MAX_RATE times its source; what is over is shared again until nothing is.
    """
    found = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    found = written(found.withColumn("_last", F.col("source").isNull()), "sources")
    placed = row_numbers(found, ["_last", "source"], "_place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighted = written(
        placed.withColumn("_weight", F.element_at(turn, (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_most", F.col("source_size") * MAX_RATE).drop("_last", "_place"),
        "weights",
    )
    total, level = weighted.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = float(total or 0) / level if level else 0.0
    while True:
        full = F.col("_most") < F.col("_weight") * level
        held, open_ = weighted.agg(
            F.sum(F.when(full, F.col("_most")).cast(_EXACT)), F.sum(F.when(~full, F.col("_weight")).cast(_EXACT))
        ).first()
        raised = (float(total) - float(held or 0)) / float(open_) if open_ else math.inf
        if raised <= level or not open_:
            break
        level = raised
    target = F.least(F.col("_most"), F.col("_weight") * F.lit(level)) if math.isfinite(level) else F.col("_most")
    return weighted.select("source", "source_size", "n", target.alias("target"))


def _rate(size: Column | str = "size") -> Column:
    size = F.col(size) if isinstance(size, str) else size
    tilted = F.least(F.lit(MAX_RATE), F.exp(F.col("tilt") * size))
    return F.when(F.col("full"), F.lit(MAX_RATE)).otherwise(tilted)


def tilts(sized: DataFrame, wanted: DataFrame, source: str = "source") -> DataFrame:
    """``wanted`` with ``tilt`` (lambda divided by the mean size) and ``full`` (every rate is MAX_RATE)."""
    spark = sized.sparkSession
    counts = written(
        sized.where("size > 0").groupBy(F.col(f"`{source}`").alias("source"), "size").agg(F.count(F.lit(1)).alias("rows")),
        "size-counts",
    )
    state, path = written_at(
        wanted.withColumn("full", F.col("target") >= F.col("source_size") * MAX_RATE * (1 - TOLERANCE))
        .withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double"))
        .withColumn("high", F.lit(None).cast("double")).withColumn("done", F.col("full")),
        "tilts",
    )
    while state.where(~F.col("done")).limit(1).count():
        open_ = state.where(~F.col("done")).withColumnRenamed("source", "_source")
        words = F.col("rows") * F.col("size")
        bent = F.when(F.exp(F.col("tilt") * F.col("size")) < MAX_RATE, F.exp(F.col("tilt") * F.col("size")))
        sums = (
            counts.join(open_, F.col("source").eqNullSafe(F.col("_source")))
            .groupBy("source")
            .agg(
                F.sum((words * _rate()).cast(_EXACT)).cast("double").alias("_got"),
                # The derivative, with sizes relative to the mean so that it fits the exact sum.
                F.coalesce(F.sum((words * F.col("size") / F.col("source_size") * F.col("n") * bent).cast(_EXACT)), F.lit(0))
                .cast("double").alias("_slope"),
            )
            .withColumnRenamed("source", "_source")
        )
        mean = F.col("source_size") / F.col("n")
        over = F.col("_got") - F.col("target")
        low = F.when(over <= 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over / (F.col("_slope") * mean)
        within = (F.coalesce(newton > low, F.lit(True))) & (F.coalesce(newton < high, F.lit(True)))
        # Outside the bracket, or where every rate is at its bound, halve the bracket or step out of it.
        step_out = F.when(low.isNull(), high - F.greatest(F.abs(high), 1 / mean)).when(
            high.isNull(), low + F.greatest(F.abs(low), 1 / mean)
        ).otherwise((low + high) / 2)
        near = F.abs(over) <= F.col("target") * TOLERANCE
        stuck = (high - low) <= F.abs(F.col("tilt")) * 1e-15
        settled = F.coalesce(near | stuck, F.lit(False)) | F.col("_got").isNull()
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
            .select(
                "source", "source_size", "n", "target", "full",
                F.when(F.col("done") | settled, F.col("tilt"))
                .when((F.col("_slope") > 0) & within, newton).otherwise(step_out).alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | settled).alias("done"),
            )
        )
        state, new_path = written_at(moved, "tilts")
        discard(spark, path)
        path = new_path
    return state.select("source", "source_size", "target", "tilt", "full")


def _urgency(key: Column) -> Column:
    """Rows are rounded up in ascending order of this: a uniform hash less the rate's fraction."""
    uniform = F.shiftrightunsigned(F.xxhash64(key, F.lit("copies")), 11) / float(1 << 53)
    return uniform - (F.col("rate") - F.floor("rate"))


def _rated(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("rate", _rate()).withColumn("urgency", _urgency(F.col(f"`{key}`")))


def thresholds(sized: DataFrame, tilted: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``tilted`` with ``bar``: a row of the source is rounded up if its urgency lies below.

    Three histograms of at most BINS bins per source close in on the bar; in the last bin the rows go
    to the side that leaves the source closer to its target.
    """
    spark = sized.sparkSession
    rows = sized.where("size > 0").select(F.col(f"`{source}`").alias("_source"), F.col(f"`{key}`"), "size")
    state = tilted.withColumn("bar", F.lit(-1.0)).withColumn("need", F.lit(None).cast("double"))
    path = None
    for level in range(LEVELS):
        width = 2.0 / BINS ** (level + 1)
        joined = _rated(rows.join(state, F.col("_source").eqNullSafe(F.col("source"))), key)
        bin_ = F.floor((F.col("urgency") - F.col("bar")) / width)
        parted = F.col("rate") > F.floor("rate")
        if level == 0:  # what is needed beyond the whole copies
            whole = joined.groupBy("source").agg(F.sum((F.col("size") * F.floor("rate"))).alias("_whole"))
            whole = whole.withColumnRenamed("source", "_source")
            state = state.join(whole, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn(
                "need", F.col("target") - F.coalesce(F.col("_whole"), F.lit(0))
            ).drop("_whole", "_source")
        bins = (
            joined.where(parted).withColumn("_bin", bin_).where((F.col("_bin") >= 0) & (F.col("_bin") < BINS))
            .groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
        )
        upto = Window.partitionBy("source").orderBy("_bin")
        bins = bins.withColumn("_sum", F.sum("_words").over(upto)).withColumnRenamed("source", "_source")
        met = bins.join(state.select(F.col("source").alias("_own"), "need"), F.col("_source").eqNullSafe(F.col("_own")))
        crossed = met.groupBy("_source").agg(
            # First bin that reaches the need, and what the bins before it hold.
            F.min(F.when(F.col("_sum") >= F.col("need"), F.struct("_bin", "_words", "_sum"))).alias("_at"),
            F.max("_sum").alias("_all"), F.max("_bin").alias("_top"),
        )
        before = F.coalesce(F.col("_at._sum") - F.col("_at._words"), F.col("_all"), F.lit(0))
        at = F.coalesce(F.col("_at._bin"), F.col("_top") + 1, F.lit(0))
        if level == LEVELS - 1:
            closer = (F.col("_at._sum") - F.col("need")) < (F.col("need") - before)
            at = at + F.when(closer, 1).otherwise(0)
        state = state.join(crossed, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "tilt", "full",
            F.when(F.col("need") > 0, F.col("bar") + at * width).otherwise(F.col("bar")).alias("bar"),
            (F.col("need") - before).alias("need"),
        )
        old = path
        state, path = written_at(state, "bars")
        if old:
            discard(spark, old)
    # Single rows then change sides: each time the one that leaves least missing or over.
    state = state.withColumn("moved", F.lit(None).cast("array<double>"))
    for _ in range(MOVES):
        joined = _rated(rows.join(state, F.col("_source").eqNullSafe(F.col("source"))), key)
        taken = joined.groupBy("source").agg(F.sum(F.col("size") * copies()).alias("_taken"))
        taken = taken.withColumnRenamed("source", "_taken_source")
        short = state.join(taken, F.col("source").eqNullSafe(F.col("_taken_source")), "left").withColumn(
            "need", F.col("target") - F.coalesce(F.col("_taken"), F.lit(0))
        ).drop("_taken", "_taken_source")
        short = written(short, "bars")
        joined = _rated(rows.join(short, F.col("_source").eqNullSafe(F.col("source"))), key)
        gap = F.abs(F.col("size") - F.abs("need"))
        right_way = F.when(F.col("need") > 0, ~_up()).otherwise(_up())
        movable = (F.col("rate") > F.floor("rate")) & right_way & ~_moved() & (gap < F.abs("need"))
        best = joined.where(movable).groupBy("source").agg(
            F.min(F.struct(gap.alias("gap"), F.col("urgency"))).alias("_best")
        ).withColumnRenamed("source", "_best_source")
        state = written(
            short.join(best, F.col("source").eqNullSafe(F.col("_best_source")), "left").withColumn(
                "moved",
                F.when(F.col("_best").isNull(), F.col("moved"))
                .otherwise(F.concat(F.coalesce("moved", F.array().cast("array<double>")), F.array("_best.urgency"))),
            ).drop("_best", "_best_source", "need"),
            "bars",
        )
    return state


def _up() -> Column:
    return (F.col("rate") > F.floor("rate")) & (F.col("size") > 0) & (F.col("urgency") < F.col("bar"))


def _moved() -> Column:
    return F.coalesce(F.array_contains("moved", F.col("urgency")), F.lit(False))


def copies() -> Column:
    """Whole copies of a row that carries ``rate``, ``urgency`` and its source's ``bar`` and ``moved``."""
    changes = (F.col("rate") > F.floor("rate")) & (F.col("size") > 0) & _moved()
    return (F.floor("rate") + (_up() != changes).cast("int")).cast("bigint")


def mixed(
    df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    A null source is a source of its own; a text without words has rate 1; rows with one key share
    one decision; input columns with the name of a computed one are replaced. The texts are counted
    once for the fit and again for the rows that are returned, unless ``df`` has no text to carry.
    """
    made = ["size", "source_size", "target", "rate", "copies"]
    carried = without(df.select(*[f"`{c}`" for c in keep]) if keep is not None else df, made)
    sized = written(
        df.select(F.col(f"`{key}`").alias("__llm_key"), F.col(f"`{source}`").alias("__llm_source"), size_of(text).alias("size")),
        "sizes",
    )
    wanted = written(targets(sized, "__llm_source", weights), "targets")
    params = thresholds(sized, tilts(sized, wanted, "__llm_source"), "__llm_key", "__llm_source")
    params = params.select(*[F.col(c).alias(f"__llm_p_{c}") for c in params.columns])
    if set(carried) <= {key, source}:  # nothing else is returned: no need to read the texts again
        rows = sized.select("size", "__llm_key", "__llm_source", *[
            F.col("__llm_key" if c == key else "__llm_source").alias(f"__llm_c_{c}") for c in carried
        ])
    else:
        rows = df.select(
            size_of(text).alias("size"), F.col(f"`{key}`").alias("__llm_key"), F.col(f"`{source}`").alias("__llm_source"),
            *[F.col(f"`{c}`").alias(f"__llm_c_{c}") for c in carried],
        )
    joined = rows.join(params, F.col("__llm_source").eqNullSafe(F.col("__llm_p_source")))
    named = joined.select(
        *[f"`__llm_c_{c}`" for c in carried], "size", "__llm_key",
        *[F.col(f"__llm_p_{c}").alias(c) for c in ("source_size", "target", "tilt", "full", "bar", "moved")],
    )
    return _rated(named, "__llm_key").select(
        *[F.col(f"`__llm_c_{c}`").alias(c) for c in carried], "size", "source_size", "target", "rate", copies().alias("copies")
    )


def repeated(mixed_rows: DataFrame) -> DataFrame:
    """Every row as often as its ``copies`` say."""
    return mixed_rows.withColumn("__llm_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("__llm_copy")
