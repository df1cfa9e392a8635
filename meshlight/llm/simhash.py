"""SimHash fingerprints and their near duplicates.

A fingerprint has 64 bits; two are linked when at most four differ. Four differing bits touch at
most four of the eight bytes, so linked fingerprints share at least four positional bytes. The index
lists, for triples of byte positions, the fingerprints that hold the same three bytes there. Twenty
triples are enough for every four positions to contain one of them, so each linked pair meets in
some list. There the shared bytes of a pair are tallied, pairs with fewer than four are dropped, and
the rest are verified bit by bit. Only distinct fingerprints are indexed: copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.llm import words as W
from meshlight.llm.batches import appended, without
from meshlight.llm.components import components
from meshlight.session import written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
# Lists longer than this are compared block against block, each pair of blocks in a task of its own.
BLOCK = 2048


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions such that any four positions contain one.

    Positions are put in three classes; taken are the triples within a class and those with two
    positions in one class and one in the next.
    """
    of = {p: p % 3 for p in range(8)}

    def taken(t: tuple[int, ...]) -> bool:
        held = sorted(of[p] for p in t)
        if held[0] == held[2]:
            return True
        if held[0] != held[1] and held[1] != held[2]:
            return False
        pair = held[1]
        single = held[0] if held[2] == pair else held[2]
        return single == (pair + 1) % 3

    return [t for t in combinations(range(8), 3) if taken(t)]


def _fingerprints(texts: pa.Array) -> dict[str, np.ndarray]:
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for run in W.runs(texts, lower=True):
        starts, ends, doc = run.segments(W.SPACE)
        if not len(starts):
            continue
        # One space after every word: a shingle is then a slice.
        held = ~W.SPACE[run.data]
        data = np.where(held, run.data, np.uint8(0x20))
        held[ends[ends < len(held)]] = True
        place = np.zeros(len(held) + 1, np.int64)
        np.cumsum(held, out=place[1:])
        text, starts, ends = data[held].tobytes(), place[starts], place[ends]

        counts = W.counts_per(doc, run.n)
        first = np.cumsum(counts) - counts
        shingles = np.where(counts > 0, np.maximum(1, counts - SHINGLE + 1), 0)
        present = np.flatnonzero(shingles)
        offsets = np.cumsum(shingles) - shingles
        head = np.repeat(first - offsets, shingles) + np.arange(shingles.sum())
        tail = np.minimum(head + SHINGLE - 1, np.repeat(first + counts - 1, shingles))
        hashes = np.fromiter(
            (digest(text[a:b], SEED) for a, b in zip(starts[head].tolist(), ends[tail].tolist())),
            np.uint64, len(head),
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, offsets[present], axis=0, dtype=np.int64)
        major = ones * 2 > shingles[present][:, None]
        out[run.first + present] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return {"fingerprint": out.view(np.int64)}


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (long) of each whole text.

    Words are maximal runs without ASCII white space, A-Z in lower case; fewer than four words make
    one shingle. Null, empty and blank texts have no words and the fingerprint zero.
    """
    return appended(df, text, "fingerprint bigint", _fingerprints, keep)


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of links: tally shared positional bytes, then verify the differing bits."""
    differ = left[:, None] ^ right[None, :]
    used = differ | (differ >> np.uint64(4))
    used |= used >> np.uint64(2)
    used |= used >> np.uint64(1)
    shared = 8 - np.bitwise_count(used & np.uint64(0x0101010101010101))
    near = shared >= MIN_SHARED
    near[near] = np.bitwise_count(differ[near]) <= MAX_BITS
    return near


def _forest(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of the values that span their components: (smallest reached first, member)."""
    if len(values) == 2:
        return ([0], [1]) if _near(values[:1], values[1:])[0, 0] else ([], [])
    roots, members = [], []
    open_ = np.ones(len(values), bool)
    for start in range(len(values)):
        if not open_[start]:
            continue
        open_[start] = False
        frontier = np.array([start])
        while len(frontier):
            left = np.flatnonzero(open_)
            if not len(left):
                break
            step = max(1, (1 << 20) // len(left))
            hit = np.zeros(len(left), bool)
            for i in range(0, len(frontier), step):
                hit |= _near(values[frontier[i : i + step]], values[left]).any(axis=0)
            frontier = left[hit]
            open_[frontier] = False
            roots += [start] * len(frontier)
            members += frontier.tolist()
    return roots, members


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each list; rows come sorted by list, a list may go over several batches."""
    keys, values = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)

    def found(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        begins, closes = np.append(0, cuts), np.append(cuts, len(keys))
        several = closes - begins > 1
        a, b = [], []
        for i, j in zip(begins[several].tolist(), closes[several].tolist()):
            roots, members = _forest(values[i:j])
            a.append(values[i:j][roots])
            b.append(values[i:j][members])
        if not a:
            return None
        ends = [np.concatenate(x).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    for batch in batches:
        new = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        keys = np.concatenate([keys, new])
        values = np.concatenate([values, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))  # sorted: the open list is the tail
        if last:
            if (out := found(keys[:last], values[:last])) is not None:
                yield out
            keys, values = keys[last:], values[last:]
    if len(keys) and (out := found(keys, values)) is not None:
        yield out


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all links would, from distinct fingerprints.

    A list with many entries is split into hashed blocks; every pair of blocks is compared in its own
    group of at most about twice ``block`` rows, so that no list ever has to fit one task.
    """
    spark = distinct.sparkSession
    postings = []
    for number, triple in enumerate(triples()):
        value = F.lit(number)
        for p in triple:
            value = F.shiftleft(value.cast("bigint"), 8) + F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255))
        postings.append(value)
    index = distinct.select("fingerprint", F.explode(F.array(*postings)).alias("list"))
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    met = (
        index.join(sizes, "list").withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(n, "list", "low", "high").sortWithinPartitions("list", "low", "high", "fingerprint")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def classes(fingerprinted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fingerprint, class) of each distinct fingerprint; class is the smallest one it is joined to."""
    distinct = written(fingerprinted.select("fingerprint").distinct(), "fingerprints")
    found = components(links(distinct, block))
    return distinct.join(found, distinct["fingerprint"] == found["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("class")
    )


def linked(fingerprinted: DataFrame, id_column: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Add ``component_id``: the smallest id reachable over links between fingerprints.

    Rows with a null id take part; a component of null ids alone has a null component_id. ``fingerprinted``
    is read more than once and should be a written table.
    """
    least = fingerprinted.groupBy("fingerprint").agg(F.min(id_column).alias("_least"))
    grouped = written(classes(fingerprinted, block).join(least, "fingerprint"), "classes")
    smallest = grouped.groupBy("class").agg(F.min("_least").alias("component_id"))
    named = grouped.join(smallest, "class").select("fingerprint", "component_id")
    rows = fingerprinted.select(*[f"`{c}`" for c in without(fingerprinted, ["component_id"])])
    return rows.join(named, "fingerprint")


def representatives(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest id (nulls last), then the smallest row hash.

    Rows that agree in every column are one row. The texts are shuffled once, to their verdicts.
    """
    names = df.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    marked = fingerprints(df.withColumn("__llm_row", row), text)
    rank = F.struct(F.col(f"`{id_column}`").isNull().alias("last"), F.col(f"`{id_column}`"), F.col("__llm_row"))
    narrow = written(marked.select("fingerprint", rank.alias("rank")), "simhash")
    of = classes(narrow)
    best = (
        narrow.groupBy("fingerprint").agg(F.min("rank").alias("rank"))
        .join(of, "fingerprint").groupBy("class").agg(F.min("rank").alias("rank"))
        .select(F.col(f"rank.{id_column}").alias("__llm_id"), F.col("rank.__llm_row").alias("__llm_best"))
    )
    keyed = df.withColumn("__llm_row", row)
    mine = (keyed["__llm_row"] == best["__llm_best"]) & keyed[id_column].eqNullSafe(best["__llm_id"])
    return keyed.join(best, mine, "left_semi").dropDuplicates(["__llm_row", id_column]).select(*[f"`{c}`" for c in names])
