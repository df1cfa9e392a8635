"""Mergeable states of series per group and time chunk, and trailing windows made of them.

A state holds counts, moments and extremes of the readings of one chunk. Chunks wholly inside a window are
merged from their states; readings themselves are looked at again only in the chunk that a window's
start falls into, and only where it falls between two readings. States of one chunk that come from
several batches merge as well, so that ingest keeps them up (``streaming.ingest``).

Moments are taken around each chunk's mean and merged around a value of the group's own, so that large
values with small spread lose no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight.session import written

HOUR = 3_600_000_000  # microseconds
CHUNK_ROWS = 1 << 20  # readings of one group and chunk that are sorted in one task
STATE = (
    "rows bigint, n bigint, mean double, m2 double, low double, high double, first timestamp, last timestamp, "
    "t double, tt double, tv double, below bigint"
)
_TYPES = [tuple(f.split()) for f in STATE.split(", ")]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def chunk_start(at: Column, length: int) -> Column:
    """The start, in microseconds, of the chunk that holds a time in microseconds."""
    return at - F.pmod(at, F.lit(length))


def days(ts: Column) -> Column:
    return micros(ts) / 86_400_000_000.0


def readings(value: Column, ts: Column, present: Column | None = None, threshold: float | None = None) -> Column:
    """The state of the readings that are ``present`` (by default all rows, also those without a value)."""
    v = value if present is None else F.when(present, value)
    at = ts if present is None else F.when(present, ts)
    t = F.when(v.isNotNull(), days(ts))
    n = F.count(v)
    return F.struct(
        F.count(at).alias("rows"), n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.min(at).alias("first"), F.max(at).alias("last"),
        F.avg(t).alias("t"), (F.var_pop(t) * n).alias("tt"), (F.covar_pop(t, v) * n).alias("tv"),
        (F.count_if(v < threshold) if threshold is not None else F.lit(0).cast("bigint")).alias("below"),
    )


def merged(state: Column, origin: Column, origin_t: Column) -> Column:
    """The state of several states, around ``origin`` and ``origin_t``, which are the same in a group."""
    n, mean, t = state["n"], state["mean"], state["t"]
    by, by_t = mean - origin, t - origin_t
    total = F.sum(n)
    shift, shift_t = F.try_divide(F.sum(n * by), total), F.try_divide(F.sum(n * by_t), total)

    def spread(inner: str, left: Column, right: Column, both: Column) -> Column:
        # Rounding may leave a little below nothing.
        return F.when(total > 0, F.sum(state[inner] + n * left * right) - total * both)

    first = F.min(origin)
    return F.struct(
        F.sum(state["rows"]).alias("rows"), total.alias("n"), (first + shift).alias("mean"),
        F.when(total > 0, F.greatest(F.lit(0.0), spread("m2", by, by, shift * shift))).alias("m2"),
        F.min(state["low"]).alias("low"), F.max(state["high"]).alias("high"),
        F.min(state["first"]).alias("first"), F.max(state["last"]).alias("last"),
        (F.min(origin_t) + shift_t).alias("t"),
        F.when(total > 0, F.greatest(F.lit(0.0), spread("tt", by_t, by_t, shift_t * shift_t))).alias("tt"),
        spread("tv", by_t, by, shift_t * shift).alias("tv"), F.sum(state["below"]).alias("below"),
    )


def added_up(held: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """One state for each key ``by`` of states that may come several times, from several batches."""
    same = Window.partitionBy(*by)
    near = F.coalesce(F.max_by(F.col(state)["mean"], F.col(state)["last"]).over(same), F.lit(0.0))
    near_t = F.coalesce(F.max(F.col(state)["t"]).over(same), F.lit(0.0))
    placed = held.select(*by, state, near.alias("_near"), near_t.alias("_near_t"))
    return placed.groupBy(*by).agg(merged(F.col(state), F.col("_near"), F.col("_near_t")).alias(state))


def deviation(state: Column) -> Column:
    """Sample deviation; 0 with fewer than two values."""
    return F.when(state["n"] > 1, F.sqrt(state["m2"] / (state["n"] - 1))).otherwise(0.0)


def slope(state: Column) -> Column:
    """Least-squares slope per day; 0 with fewer than two values or a single instant."""
    return F.when((state["n"] > 1) & (state["low"].isNotNull()) & (state["tt"] > 0), state["tv"] / state["tt"]).otherwise(0.0)


def states(
    rows: DataFrame, by: Sequence[str], features: Sequence[str], keep_nulls: bool = False,
    thresholds: dict[str, float] | None = None, length: int = HOUR,
) -> DataFrame:
    """(by, chunk, a state per feature): one hash aggregation with map-side combine.

    With ``keep_nulls`` a row without a value counts as a reading of the feature, otherwise it does not.
    """
    ts, at = F.col("ts"), chunk_start(micros(F.col("ts")), length)
    found = [
        readings(F.col(f).cast("double"), ts, None if keep_nulls else F.col(f).isNotNull(), (thresholds or {}).get(f)).alias(f)
        for f in features
    ]
    return rows.groupBy(*by, at.alias("chunk")).agg(*found)


def of_maps(snapshots: DataFrame, length: int = HOUR) -> DataFrame:
    """(device_id, feature, chunk, state) of snapshots whose features are a map."""
    rows = snapshots.select("device_id", "ts", F.explode("features").alias("feature", "value")).where("value IS NOT NULL")
    return states(rows, ["device_id", "feature"], ["value"], length=length).withColumnRenamed("value", "state")


def side_by_side(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """States (device_id, feature, chunk, state) as ``states`` gives them: a column a feature."""
    picked = [F.max(F.when(F.col("feature") == f, F.col("state"))).alias(f) for f in features]
    rows = long.where(F.col("feature").isin(list(features))).groupBy("device_id", "chunk").agg(*picked)
    empty = F.struct(*[(F.lit(0).cast("bigint") if n in ("rows", "n", "below") else F.lit(None).cast(t)).alias(n) for n, t in _TYPES])
    return rows.select("device_id", "chunk", *[F.coalesce(f, empty).alias(f) for f in features])


def trailing(
    rows: DataFrame, by: Sequence[str], features: Sequence[str], windows: dict[str, int], keep_nulls: bool = False,
    thresholds: dict[str, float] | None = None, length: int = HOUR, held: DataFrame | None = None,
) -> DataFrame:
    """(by, feature, window, state): the state of every feature's trailing windows.

    A window of w microseconds ends at the group's last reading of the feature and is open at the start.
    ``held`` are the states of ``rows`` if they are at hand. A group without a reading has no row.
    """
    by, names = list(by), list(windows)
    held = written(states(rows, by, features, keep_nulls, thresholds, length), "chunk-states") if held is None else held
    group = Window.partitionBy(*by)
    ends = {f: F.struct(
        F.max(F.col(f)["last"]).over(group).alias("end"), F.max_by(F.col(f)["mean"], F.col(f)["last"]).over(group).alias("near")
    ) for f in features}
    placed = held.select(*by, "chunk", *features, *[e.alias(f"_end_{f}") for f, e in ends.items()])
    pairs = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(w).alias("window"), F.col(f).alias("state"), F.col(f"_end_{f}.end").alias("end"),
            F.col(f"_end_{f}.near").alias("near"), F.lit(windows[w]).alias("reach"),
        )
        for f in features for w in names
    ])
    long = placed.select(*by, "chunk", F.explode(pairs).alias("p")).select(
        *by, "chunk", "p.feature", "p.window", "p.state", "p.near", days(F.col("p.end")).alias("end_t"),
        (micros(F.col("p.end")) - F.col("p.reach")).alias("start"),
    ).where(F.col("state.rows") > 0)
    first, last = micros(F.col("state.first")), micros(F.col("state.last"))
    whole = long.where(first > F.col("start"))
    cut = long.where((first <= F.col("start")) & (last > F.col("start")))
    keys = cut.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("chunk").alias("_chunk"), "feature", "window", "near", "end_t", "start")

    # The readings of the chunks that a start cuts: at most one chunk a group, feature and window.
    here = rows.withColumn("_at", micros(F.col("ts")))
    spans = keys.agg(F.struct(F.min("_chunk").alias("a"), (F.max("_chunk") + length).alias("b")).alias("s")).scalar()
    here = here.withColumn("_span", spans).where((F.col("_at") >= F.col("_span.a")) & (F.col("_at") < F.col("_span.b")))
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [chunk_start(F.col("_at"), length) == F.col("_chunk")]
    met = here.join(keys, same).where(F.col("_at") > F.col("start"))
    value, below = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f in features:
        value = F.when(F.col("feature") == f, F.col(f).cast("double")).otherwise(value)
        if f in (thresholds or {}):
            below = F.when(F.col("feature") == f, F.lit(thresholds[f])).otherwise(below)
    met = met.select(*by, "feature", "window", "near", "end_t", "ts", value.alias("_v"), below.alias("_below"))
    v = F.col("_v")
    state = readings(v, F.col("ts"), None if keep_nulls else v.isNotNull())
    ends = met.groupBy(*by, "feature", "window", "near", "end_t").agg(
        state.withField("below", F.count_if(v < F.col("_below"))).alias("state")
    )
    parts = whole.select(*by, "feature", "window", "near", "end_t", "state").unionByName(
        ends.where(F.col("state.rows") > 0).select(*by, "feature", "window", "near", "end_t", "state")
    )
    return parts.groupBy(*by, "feature", "window").agg(
        merged(F.col("state"), F.coalesce("near", F.lit(0.0)), F.col("end_t")).alias("state")
    )


def wide(long: DataFrame, by: Sequence[str], columns: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """One row per group: ``columns`` maps a name to (feature, window, what to take of its state)."""
    picked = [
        F.max(F.when((F.col("feature") == f) & (F.col("window") == w), take)).alias(name) for name, (f, w, take) in columns.items()
    ]
    return long.groupBy(*by).agg(*picked)


def chunk_length(rows: DataFrame, by: Sequence[str], length: int = HOUR, most: int | None = None) -> int:
    """``length``, halved until no group has more than ``most`` readings in a chunk.

    Sorted work deals out by group and chunk, so that a busy group's hour is cut as finely as its readings
    ask for. One counting aggregation for each halving that turns out to be needed, and one more; a
    chunk cannot be cut below a microsecond, nor where its length is odd.
    """
    most = most or CHUNK_ROWS
    while True:
        at = chunk_start(micros(F.col("ts")), length)
        counts = rows.groupBy(*by, at.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        if largest <= most or length % 2 or length <= 1:
            return length
        length //= 2


def per_reading(
    rows: DataFrame, by: Sequence[str], value: str = "value", window: int = 24 * HOUR, length: int | None = None
) -> DataFrame:
    """Every reading with mean, std, min, max and count of its own trailing window, (ts - window, ts].

    The window of a reading is the beginning of its own chunk, the whole chunks before it, and the end of the
    chunk its start falls into. The chunk length divides the window, so that the last of these is met by
    moving those readings forward by the window: both ends are running aggregates inside one
    (group, chunk), and the chunks between are carried in as one merged state. No group is one task.
    Readings at one time see each other. Nulls count as readings without a value.
    """
    by = list(by)
    if length is None:
        length = chunk_length(rows, by, HOUR if window % HOUR == 0 else window)
    if window % length:
        raise ValueError("the chunk length must divide the window")
    own = rows.select(*by, "ts", F.col(value).cast("double").alias("v"), micros(F.col("ts")).alias("at"), F.lit(0).alias("old"))
    moved = own.withColumn("at", F.col("at") + window).withColumn("old", F.lit(1))
    line = own.unionByName(moved).withColumn("chunk", chunk_start(F.col("at"), length))
    inside = Window.partitionBy(*by, "chunk")
    up_to = inside.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    after = inside.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)

    def ends(old: int, frame) -> Column:
        mine = F.col("old") == old
        v = F.when(mine, F.col("v"))
        n = F.count(v).over(frame)
        return F.struct(
            F.count_if(mine).over(frame).alias("rows"), n.alias("n"), F.avg(v).over(frame).alias("mean"),
            (F.var_pop(v).over(frame) * n).alias("m2"), F.min(v).over(frame).alias("low"), F.max(v).over(frame).alias("high"),
        )

    placed = line.withColumn("_new", ends(0, up_to)).withColumn("_old", ends(1, after)).where("old = 0")
    # States of whole chunks; for each chunk that has readings, the merged state of those between.
    v = F.col("v")
    held = own.groupBy(*by, chunk_start(F.col("at"), length).alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("low"), F.max(v).alias("high"),
    )
    group = Window.partitionBy(*by)
    held = held.withColumn("near", F.coalesce(F.max_by("mean", "chunk").over(group), F.lit(0.0)))
    if window > length:
        between = group.orderBy("chunk").rangeBetween(length - window, -length)
        off = F.col("mean") - F.col("near")
        middle = F.struct(
            F.sum("rows").over(between).alias("rows"), F.sum("n").over(between).alias("n"),
            F.sum(F.col("n") * off).over(between).alias("s"), F.sum(F.col("m2") + F.col("n") * off * off).over(between).alias("q"),
            F.min("low").over(between).alias("low"), F.max("high").over(between).alias("high"),
        )
    else:
        nothing = F.lit(None)
        middle = F.struct(
            nothing.cast("bigint").alias("rows"), nothing.cast("bigint").alias("n"), nothing.cast("double").alias("s"),
            nothing.cast("double").alias("q"), nothing.cast("double").alias("low"), nothing.cast("double").alias("high"),
        )
    carried = held.select(*by, "chunk", "near", middle.alias("_mid"))
    found = placed.join(carried, [*by, "chunk"])
    near, zero = F.col("near"), F.lit(0)

    def part(state: str, off: str) -> tuple[Column, Column]:
        n, gap = F.col(f"{state}.n"), F.col(f"{state}.mean") - near
        return F.coalesce(n * gap, F.lit(0.0)), F.coalesce(F.col(f"{state}.m2") + n * gap * gap, F.lit(0.0))

    (s0, q0), (s1, q1) = part("_new", "near"), part("_old", "near")
    total = F.col("_new.n") + F.col("_old.n") + F.coalesce("_mid.n", zero)
    sums = found.select(
        *by, "ts", F.col("v").alias(value),
        (F.col("_new.rows") + F.col("_old.rows") + F.coalesce("_mid.rows", zero)).alias("count"), total.alias("_n"), near.alias("_near"),
        (s0 + s1 + F.coalesce("_mid.s", F.lit(0.0))).alias("_s"), (q0 + q1 + F.coalesce("_mid.q", F.lit(0.0))).alias("_q"),
        F.least("_new.low", "_old.low", "_mid.low").alias("min"), F.greatest("_new.high", "_old.high", "_mid.high").alias("max"),
    )
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"))
    return sums.select(
        *by, "ts", value, F.when(F.col("_n") > 0, F.col("_near") + F.col("_s") / F.col("_n")).alias("mean"),
        F.when(F.col("_n") > 1, F.sqrt(spread / (F.col("_n") - 1))).otherwise(0.0).alias("std"), "min", "max", "count",
    )
