"""Whitening of embedding vectors by principal components that are right to double precision.

An entry c is measured as the whole number x = floor(64 c); a constant added to all x changes nothing
below. Sums S and the products of the centred whole numbers n x - S are exact: a task cuts them into limbs
of 21 bits, whose products fit into doubles, and Spark adds the partial products as decimals. So neither
the order of the rows nor their distance from zero has any effect on the covariance.

The covariance has one row and column an entry of the vectors, whatever the number of rows, and its
eigenvectors are found on the driver: in single precision first, then corrected by Ogita and Aishima's
iteration, which is matrix products alone, in extended precision (``numpy.longdouble``; where a machine
has none it is double). Eigenvalues closer than the iteration can tell apart form clusters; the
covariance restricted to a cluster's space, shifted by its mean, is solved on its own and the iteration
goes on, so that the cluster's inner directions come out as well.

Rows: vectors that are null or hold a null or an entry that is not finite are dropped, and so are vectors
of another length than the most frequent one (the longer of two). Entries beyond 2^62 / 64 count as
that. Repeated rows count once each, and extra columns travel along unless they have the name of
a computed one. A component without variance (fewer independent vectors than entries) has no
whitened value: null. An empty table has a model of no components, and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshlight.llm.batches import without
from meshlight.session import written

SCALE = 64
LIMIT = 1 << 62
COMPONENTS = 32
LIMB = 21
EXACT_ROWS = 1 << 11  # products of two limbs add up exactly in a double over so many rows
SENT_CHUNKS = 1 << 7  # chunks whose sums are sent on as one
_VECTOR = "__vector"
COLUMNS = "deviation decimal(38,0), whitened array<double>"
_BIG = pa.decimal128(38, 0)


@dataclass
class Model:
    """n vectors of ``width`` entries, their sums, and components by falling eigenvalue."""

    n: int
    width: int
    sums: list[int]
    values: np.ndarray  # eigenvalues
    vectors: np.ndarray  # one column a component
    trace: float

    @property
    def rank(self) -> int:
        """How many leading components have a variance above rounding."""
        if not len(self.values) or self.values[0] <= 0:
            return 0
        return int((self.values > self.width * np.finfo(float).eps * self.values[0]).sum())

    def explained(self, components: int = COMPONENTS) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values[:components]]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has only finite entries, as doubles in one more column."""
    finite = F.forall(_VECTOR, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above all
    return df.withColumn(_VECTOR, F.col(f"`{vector}`").cast("array<double>")).where(F.col(_VECTOR).isNotNull() & finite)


def _entries(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Whole numbers of a batch whose vectors all have ``width`` entries."""
    entries = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * entries.reshape(batch.num_rows, width))
    return np.clip(x, -LIMIT, LIMIT).astype(np.int64)


def _sums(vectors: DataFrame) -> DataFrame:
    """(width, entry, n, total): exact sums for each length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            widths = pc.list_value_length(batch.column(0)).to_numpy()
            for width in np.unique(widths[widths > 0]).tolist():
                x = _entries(batch.filter(pa.array(widths == width)), width)
                low = 31
                parts = np.array([(x >> low).sum(0), (x & ((1 << low) - 1)).sum(0)]).astype(object)
                n, total = found.get(width, (0, 0))
                found[width] = [n + len(x), total + (parts[0] << low) + parts[1]]
        for width, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(np.full(width, n)),
                 pa.array([Decimal(int(t)) for t in total], _BIG)],
                ["width", "entry", "n", "total"],
            )

    parts = vectors.select(_VECTOR).mapInArrow(run, "width bigint, entry bigint, n bigint, total decimal(38,0)")
    return parts.groupBy("width", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n x - S, in 64 bits where it surely fits and in Python's whole numbers elsewhere."""
    if n * (2 * largest + 1) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _limbs(w: np.ndarray) -> list[np.ndarray]:
    """w as limbs of 21 bits, lowest first; the last one has the sign."""
    out = []
    while True:
        if max(int(w.max()), -int(w.min())) < 1 << LIMB:
            return [*out, w.astype(float)]
        out.append((w & ((1 << LIMB) - 1)).astype(float))
        w = w >> LIMB


def _largest(x: np.ndarray, sums: list[int], n: int) -> int:
    """A bound of |x| and of the mean's absolute value."""
    return max(int(np.abs(x).max(initial=0)), max((abs(s) // n + 1 for s in sums), default=0))


def _products(vectors: DataFrame, n: int, width: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of the centred whole numbers, for each pair of entries i <= k."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        chunks = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for shift, total in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(upper[0]), pa.array(upper[1]), pa.array(np.full(len(upper[0]), shift)), pa.array(total[upper])],
                    ["i", "k", "shift", "total"],
                )

        for batch in batches:
            x = _entries(batch, width)
            for first in range(0, len(x), EXACT_ROWS):
                part = x[first : first + EXACT_ROWS]
                limbs = _limbs(_centred(part, n, sums, _largest(part, sums, n)))
                for p, left in enumerate(limbs):
                    for q, right in enumerate(limbs):
                        held[p + q] = held.get(p + q, 0) + (left.T @ right).astype(np.int64)
                chunks += 1
                if chunks == SENT_CHUNKS:
                    yield from sent()
                    held, chunks = {}, 0
        yield from sent()

    parts = vectors.select(_VECTOR).where(F.size(_VECTOR) == width).mapInArrow(run, "i bigint, k bigint, shift bigint, total bigint")
    # As many rows as the covariance has entries, a few times.
    rows = parts.groupBy("i", "k", "shift").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    products: dict[tuple[int, int], int] = {}
    for r in rows:
        products[r.i, r.k] = products.get((r.i, r.k), 0) + (int(r.total) << LIMB * r.shift)
    return products


def _extended(numerator: int, denominator: int) -> np.longdouble:
    """A fraction in extended precision: the nearest double, and the rest."""
    near = numerator / denominator
    rest = Fraction(numerator, denominator) - Fraction(near)
    return np.longdouble(near) + np.longdouble(float(rest))


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, as extended precision has them."""
    width = len(a)
    wide = np.longdouble
    a = a.astype(wide)
    scale = np.trace(a) / width if width else wide(0)
    if not scale > 0:
        return np.zeros(width, wide), np.eye(width, dtype=wide)
    a = a / scale
    unit = np.eye(width, dtype=wide)
    size = np.sqrt((a * a).sum())
    enough = width * max(np.finfo(wide).eps, 2.0**-62)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    for _ in range(8):
        before = np.inf
        for _ in range(12):
            r = unit - x.T @ x
            s = x.T @ (a @ x)
            values = np.diag(s) / (1 - np.diag(r))
            off = s - np.diag(values)
            unsure = max(enough * size, 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())))
            gaps = values[None, :] - values[:, None]
            close = np.abs(gaps) <= unsure
            step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
            x = x + x @ step
            largest = np.abs(step).max()
            if largest <= enough or largest > before / 2:
                break
            before = largest
        clusters = _clusters(values, unsure)
        mixed = [j for j in clusters if np.abs(off[np.ix_(j, j)] * (1 - np.eye(len(j)))).max() > enough * size]
        if not mixed:
            break
        for j in mixed:  # solve inside the cluster's space, where the gaps are no longer small
            inner = x[:, j].T @ (a @ x[:, j])
            inner = (inner + inner.T) / 2
            inner -= np.trace(inner) / len(j) * np.eye(len(j), dtype=wide)
            turn = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))[1]
            x[:, j] = x[:, j] @ turn.astype(wide)
    for _ in range(4):  # rounding between all but equal eigenvalues may have left angles
        x = x @ (3 * unit - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    peak = np.abs(x).argmax(0)
    return values[order] * scale, x * np.sign(x[peak, np.arange(width)])


def _clusters(values: np.ndarray, unsure: float) -> list[np.ndarray]:
    """Runs of neighbouring eigenvalues that lie within ``unsure`` of each other, of two at least."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > unsure) + 1
    return [j for j in np.split(order, cuts) if len(j) > 1]


def fit(df: DataFrame, vector: str = "embedding") -> Model:
    """Sums, covariance and components over all usable vectors."""
    vectors = usable(df, vector)
    sums = written(_sums(vectors), "vector-sums")
    widest = sums.where("entry = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return Model(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, width = widest.n, widest.width
    totals = [int(r.total) for r in sums.where(F.col("width") == width).orderBy("entry").collect()]
    products = _products(vectors, n, width, totals)
    covariance = np.zeros((width, width), np.longdouble)
    for (i, k), total in products.items():
        covariance[i, k] = covariance[k, i] = _extended(total, n**3)
    trace = float(_extended(sum(products[i, i] for i in range(width)), n**3))
    values, components = eigenpairs(covariance)
    return Model(n, width, totals, values.astype(float), components.astype(float), trace)


def _whiten(x: np.ndarray, model: Model, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Centred whole numbers of the rows, and their whitened values of the components with variance."""
    k = min(components, model.rank)
    w = _centred(x, model.n, model.sums, _largest(x, model.sums, model.n))
    scaled = model.vectors[:, :k] / np.sqrt(model.values[:k])
    return w, (w / model.n).astype(float) @ scaled


def whitened(
    df: DataFrame, model: Model, vector: str = "embedding", components: int = COMPONENTS, keep: Sequence[str] | None = None
) -> DataFrame:
    """Usable rows with ``deviation``, the exact sum of squares of n x - S (null beyond 38 digits), and
    ``whitened``, one value a component."""
    added = StructType.fromDDL(COLUMNS)
    carried = without(df.select(*[f"`{c}`" for c in keep]) if keep is not None else df, added.fieldNames())
    rows = usable(df, vector).where(F.size(_VECTOR) == model.width).select(*[F.col(f"`{c}`") for c in carried], _VECTOR)
    schema = StructType([*df.select(*[f"`{c}`" for c in carried]).schema.fields, *added.fields])
    shown = min(components, model.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, values = _whiten(_entries(batch, model.width), model, components)
            small = w.dtype == np.int64 and int(np.abs(w).max(initial=0)) ** 2 * model.width < 1 << 63
            squares = ((w if small else w.astype(object)) ** 2).sum(1)
            deviation = [Decimal(d) if d < 10**38 else None for d in map(int, squares)]
            padded = np.full((len(w), shown), np.nan)
            padded[:, : values.shape[1]] = values
            flat = pa.array(padded.ravel(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, shown))[: len(w) + 1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(deviation, _BIG), lists], schema.names)

    return rows.mapInArrow(run, schema)


def identity_error(df: DataFrame, model: Model, vector: str = "embedding", components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity; null without components.

    Each task centres its values before it multiplies them and sends its means and centred products; the
    sums over tasks are of decimals, so that they do not depend on the tasks' order.
    """
    k = min(components, model.rank)
    if not k:
        return None
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _whiten(_entries(batch, model.width), model, components)[1]
            own, rows = values.mean(0), len(values)
            values = values - own
            gap = own - mean
            products += values.T @ values + np.outer(gap, gap) * (n * rows / (n + rows))
            mean += gap * (rows / (n + rows))
            n += rows
        if n:
            i = np.concatenate([upper[0], np.arange(k)])
            j = np.concatenate([upper[1], np.full(k, -1)])
            total = np.concatenate([(products + n * np.outer(mean, mean))[upper], n * mean])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total)], ["i", "j", "total"])

    rows = usable(df, vector).where(F.size(_VECTOR) == model.width).select(_VECTOR)
    parts = rows.mapInArrow(run, "i bigint, j bigint, total double")
    sums = {(r.i, r.j): float(r.total) for r in parts.groupBy("i", "j").agg(
        F.sum(F.col("total").cast("decimal(38,18)")).alias("total")).collect()}
    error = 0.0
    for i, j in zip(*upper):
        covariance = sums[i, j] / model.n - sums[i, -1] / model.n * (sums[j, -1] / model.n)
        error = max(error, abs(covariance - (i == j)))
    return float(error)
