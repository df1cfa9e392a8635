"""Order MinHash fingerprints of texts, sensitive to edit distance.

The k-mers of a text's code points are numbered by occurrence, so that repeated ones differ. For
each of ``COMPONENTS`` hash functions the ``CHOSEN`` numbered k-mers with the smallest hashes are
selected, put back into text order, and hashed together. Two texts agree in a component if they hold
the same chosen k-mers in the same order; the share of components in which they agree is their
likeness. Texts shorter than a k-mer are one k-mer; an empty text has the fingerprint of no k-mer, and a null
text is an empty one. Texts are read whole, in steps of ``BLOCK`` k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshlight.llm import words as W
from meshlight.llm.batches import text_of, without
from meshlight.operators.ordering import with_range

K = 8
COMPONENTS = 64
CHOSEN = 2
BLOCK = 1 << 14  # k-mers whose hashes are looked at together
START = 64  # code points of a text by which rows of one key are dealt

_rng = np.random.Generator(np.random.PCG64(6))
_FACTORS = (_rng.integers(0, 1 << 32, COMPONENTS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, COMPONENTS, dtype=np.uint64).astype(np.uint32)[:, None]
_STEPS = (_rng.integers(0, 1 << 63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _numbered(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of the occurrence-numbered k-mers, in text order."""
    n = len(points)
    if n < K:
        tail = np.full(K, 0xFFFFFFFF, np.uint64)  # no code point
        tail[:n] = points
        points, n = tail, K
    wide = points.astype(np.uint64) + np.uint64(1)
    kmers = np.zeros(n - K + 1, np.uint64)
    for i in range(K):
        kmers += wide[i : n - K + 1 + i] * _STEPS[i]
    kmers = W.mix(kmers)
    count = len(kmers)
    if count == 1:
        return kmers
    # Sorting the hash with the place in its low bits brings equal k-mers together in text order.
    bits = np.uint64(int(count - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    ordered = np.sort((kmers & ~low) | np.arange(count, dtype=np.uint64))
    again = np.flatnonzero((ordered[1:] & ~low) == (ordered[:-1] & ~low)) + 1
    if len(again):
        fresh = np.ones(count, bool)
        fresh[again] = False
        first = np.maximum.accumulate(np.where(fresh, np.arange(count), 0))
        place = (ordered[again] & low).astype(np.int64)
        kmers[place] = W.mix(kmers[place] + (again - first[again]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return kmers


def fingerprint(text: str) -> np.ndarray:
    """The components of a text, 16 bits each."""
    if not text:
        return np.zeros(COMPONENTS, np.uint16)
    kmers = _numbered(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    chosen = min(CHOSEN, len(kmers))
    best = np.zeros((COMPONENTS, 0), np.int64)
    values = np.zeros((COMPONENTS, 0), np.uint32)
    rows = np.arange(COMPONENTS)
    for begin in range(0, len(short), BLOCK):
        part = short[None, begin : begin + BLOCK]
        hashes = (part ^ _SHIFTS) * _FACTORS
        for _ in range(min(chosen, part.shape[1])):
            at = hashes.argmin(axis=1)
            best = np.column_stack([best, at + begin])
            values = np.column_stack([values, hashes[rows, at]])
            hashes[rows, at] = 0xFFFFFFFF
        if best.shape[1] > chosen:  # keep the smallest; of equal ones the earlier
            keep = np.argsort(values, axis=1, kind="stable")[:, :chosen]
            best, values = np.take_along_axis(best, keep, axis=1), np.take_along_axis(values, keep, axis=1)
    best.sort(axis=1)
    out = np.full(COMPONENTS, len(kmers) < CHOSEN, np.uint64)
    for i in range(chosen):
        out = W.joined(out, kmers[best[:, i]])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_of_fingerprint(components: np.ndarray) -> str:
    return components.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by as many from the start of another text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + other[:quarter]


FOLLOWED = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def followed(
    df: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """The kept columns with the fingerprints of each text and of its edited text, and likenesses.

    The next document is the next in ascending (key, text) order, null keys first, and the first one
    after the last; a single document follows itself, and repeated rows follow one another. ``key`` is
    an integer. Whole texts are dealt to ranges of key and beginning of the text in one shuffle, so that a key that
    many rows share is many ranges; each range also gets the row that opens the next range, so that no row
    has to be gathered elsewhere. Null texts are empty; an empty table has no rows.
    """
    spark = df.sparkSession
    added = StructType.fromDDL(FOLLOWED)
    carried = without(df.select(*[f"`{c}`" for c in keep]) if keep is not None else df, added.fieldNames())
    kept = df.select(*[f"`{c}`" for c in carried])
    schema = StructType([*kept.schema.fields, *added.fields])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(8, 4 * partitions)  # several a partition, so that hashing evens them out
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("__llm_key"), text_of(text).alias("__llm_text"),
        *[F.col(f"`{c}`").alias(f"__llm_c_{c}") for c in carried],
    ).withColumn("__llm_start", F.substring("__llm_text", 1, START))
    rows = with_range(rows, ["__llm_key", "__llm_start"], ranges, "__llm_range")
    # The smallest place of each range, and the range before it: a row a range. The first row of a range
    # also closes the range before; that of the first range closes the last.
    place = F.struct("__llm_key", "__llm_start")
    heads = rows.groupBy("__llm_range").agg(F.min(place).alias("__llm_least"))
    before, every = Window.orderBy("__llm_range"), Window.orderBy(F.desc("__llm_range"))
    heads = heads.select(
        "__llm_range", "__llm_least",
        F.coalesce(F.lag("__llm_range").over(before), F.first("__llm_range").over(every)).alias("__llm_before"),
    )
    rows = rows.join(F.broadcast(heads), "__llm_range")
    opening = F.when(place.eqNullSafe(F.col("__llm_least")), F.col("__llm_before"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("__llm_range").alias("r")),
        F.struct(F.lit(1).alias("side"), opening.alias("r")),
    )
    dealt = (
        rows.withColumn("__llm_to", F.explode(sides)).where("__llm_to.r IS NOT NULL")
        .select(
            F.col("__llm_to.r").alias("__llm_r"), F.col("__llm_to.side").alias("__llm_side"), "__llm_key", "__llm_text",
            *[f"`__llm_c_{c}`" for c in carried],
        )
        .repartition(partitions, "__llm_r")
        .sortWithinPartitions("__llm_r", "__llm_side", "__llm_key", "__llm_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, batch row of one, text, fingerprint) that waits for its next document

        def results(out: list) -> pa.RecordBatch:
            tables = pa.Table.from_batches([o[0] for o in out]).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in tables.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            made = list(zip(*[o[1] for o in out]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns += [pa.array(x, t) for x, t in zip(made, kinds)]
            return pa.RecordBatch.from_arrays(columns, [*carried, *added.fieldNames()])

        def finished(held: tuple, text: str, print_: np.ndarray) -> tuple:
            _, row, own, own_print = held
            new = edited(own, text)
            new_print = fingerprint(new) if new != own else own_print
            return row, (
                len(own), hashlib.sha256(new.encode()).hexdigest(), text_of_fingerprint(own_print),
                text_of_fingerprint(new_print), likeness(own_print, new_print), likeness(own_print, print_),
            )

        for batch in batches:
            out = []
            ranges_, sides_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(3)
            rest = pa.RecordBatch.from_arrays([batch.column(i) for i in range(4, batch.num_columns)], carried) if carried else None
            for i, (r, side) in enumerate(zip(ranges_, sides_)):
                if side and (held is None or held[0] != r):
                    continue  # a second row with the opening key: the first one has closed the range
                text = texts[i].as_py()
                print_ = held[3] if held is not None and held[2] == text else fingerprint(text)
                if held is not None and held[0] == r:
                    out.append(finished(held, text, print_))
                    held = None
                if not side:
                    held = (r, rest.slice(i, 1), text, print_)
            if out:
                yield results(out)

    return dealt.mapInArrow(run, schema)
