"""Text chunks with embeddings: chunking, upsert, cosine search, context and prompt tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions import text as text_functions
from meshlight.functions.barrier import settled
from meshlight.functions.rounding import fixed_text, round_even
from meshlight.functions.vectors import cosine
from meshlight.operators.store import row_hash
from meshlight.session import written
from meshlight.sources import stored

_METADATA_KEY = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")

# Rows that meet in one group of a batch search: blocks grow in number with the tables, not in size.
QUERY_BLOCK = 2048
STORE_BLOCK = 8192
BUCKET_ROWS = 64
MOST_BITS, TURNED_BITS = 48, 10
_STRIP = 128  # queries of a block compared at once, to bound memory


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of source, chunk number and the first 50 characters."""
    key = F.concat_ws(":", source, index.cast("string"), F.substring(content, 1, 50))
    return F.substring(F.sha2(key, 256), 1, 16)


def chunked(documents: DataFrame, source: str, text: str, limit: int = V.CHUNK_CHARS) -> DataFrame:
    """(source, chunk_index, id, content) rows of all documents; a projection, no shuffle."""
    rows = documents.select(
        F.col(source).cast("string").alias("source"),
        F.posexplode(text_functions.chunks(F.col(text), limit)).alias("chunk_index", "content"),
    )
    return rows.withColumn("id", chunk_id(F.col("source"), F.col("chunk_index"), F.col("content")))


def device_summary_id(device_id: Column, summary: Column) -> Column:
    key = F.concat_ws(":", F.lit("device"), device_id, F.substring(summary, 1, 50))
    return F.substring(F.sha2(key, 256), 1, 16)


def upserted(rows: DataFrame) -> DataFrame:
    """Last write per id; of writes at one time the one with the largest hash.

    Columns other than id and created_at travel as one struct.

    ``max_by`` combines map-side, so an id written millions of times ships one row per task.
    """
    others = [c for c in rows.columns if c not in ("id", "created_at")]
    last = rows.groupBy("id").agg(
        F.max_by(F.struct(*others), F.struct("created_at", row_hash(rows))).alias("_row"), F.max("created_at").alias("created_at")
    )
    return last.select("id", "_row.*", "created_at")


def write_chunks(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Upsert chunks (id, ..., created_at) into a stored table: the last write of an id stays."""
    stored.upsert(spark, path, rows, at="created_at")


def _metadata_filter(store: DataFrame, metadata: dict[str, str] | None) -> DataFrame:
    for key, value in (metadata or {}).items():
        if not _METADATA_KEY.match(key):
            raise ValueError(f"Invalid metadata key: {key}")
        store = store.where(F.try_element_at("metadata", F.lit(key)) == str(value))
    return store


def search(
    store: DataFrame, query: Sequence[float], k: int = V.TOP_K, metadata: dict[str, str] | None = None
) -> DataFrame:
    """The k rows nearest to one query vector by cosine, ties by id.

    The sort keeps k rows per task and merges those.
    """
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = _metadata_filter(store, metadata).withColumn("similarity", cosine(F.col("embedding"), vector))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows; NaN for a null or zero vector, which has no direction."""
    out = np.full((len(vectors), width), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            row = np.asarray(v, np.float64)
            norm = np.linalg.norm(row)
            out[i] = row / norm if norm > 0 else np.nan
    return out


def _blocks(rows: DataFrame, size: int) -> int:
    """Number of hashed blocks of about ``size`` rows."""
    return rows.count() // size + 1


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _best_of_groups(asked: DataFrame, held: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(query_id, id, similarity): at most k rows per query from each group that both tables share."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["asked_id"][:0], "id": right["held_id"][:0], "similarity": np.zeros(0)})
        right = right.sort_values("held_id", kind="stable")
        width = max((len(v) for v in left["asked_vec"] if v is not None), default=0)
        asked_, held_, ids = _unit(left["asked_vec"], width), _unit(right["held_vec"], width), right["held_id"].to_numpy()
        out = []
        for i in range(0, len(asked_), _STRIP):
            near = asked_[i : i + _STRIP] @ held_.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ties by id; NaN sorts last
            out.append(pd.DataFrame({
                "query_id": np.repeat(left["asked_id"].to_numpy()[i : i + _STRIP], order.shape[1]),
                "id": ids[order.ravel()],
                "similarity": np.take_along_axis(near, order, axis=1).ravel(),
            }))
        return pd.concat(out)

    kinds = dict(asked.dtypes)["asked_id"], dict(held.dtypes)["held_id"]
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(
        best, f"query_id {kinds[0]}, id {kinds[1]}, similarity double"
    ).withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _sides(store: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables under names of their own: queries may be taken from the store itself."""
    return (
        queries.select(F.col("query_id").alias("asked_id"), F.col("embedding").alias("asked_vec")),
        store.select(F.col("id").alias("held_id"), F.col("embedding").alias("held_vec")),
    )


def search_many(store: DataFrame, queries: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """Top k per query for a table of queries (query_id, embedding): (query_id, rank, id, similarity).

    Queries and store are cut into hashed blocks, and every pair of blocks meets in one group, which
    returns at most k rows per query; a merge ranks those. A null or zero vector has similarity null
    and comes last, as in ``search``; ties go by id.
    """
    asked, held = _sides(store, queries)
    query_blocks, store_blocks = _blocks(queries, QUERY_BLOCK), _blocks(store, STORE_BLOCK)
    asked = asked.withColumn("qb", _block("asked_id", query_blocks)).withColumn(
        "sb", F.explode(F.sequence(F.lit(0), F.lit(store_blocks - 1)))
    )
    held = held.withColumn("sb", _block("held_id", store_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    return _ranked(_best_of_groups(asked, held, ["qb", "sb"], k), k)


@dataclass(frozen=True)
class Buckets:
    """Random projections: in each table a vector's bucket is the signs of ``bits`` projections.

    A query looks into the ``probes`` buckets of a table whose signs it would cost the least to reach.
    """

    width: int
    bits: int
    tables: int = 6
    probes: int = 1
    seed: int = 42

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.tables, self.width, self.bits))

    def wider(self) -> Buckets:
        """More of the store for every query."""
        most = 1 << min(self.bits, TURNED_BITS)
        if self.probes < most:
            return replace(self, probes=min(most, 2 * self.probes))
        return replace(self, bits=max(0, self.bits - 1))


def buckets_for(store: DataFrame, rows: int = BUCKET_ROWS) -> Buckets:
    """Buckets of about ``rows`` rows each, if the vectors' directions are spread evenly."""
    size, width = store.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return Buckets(max(int(width or 0), 1), min(MOST_BITS, (size // rows).bit_length()))


def _in_buckets(rows: DataFrame, vec: str, buckets: Buckets, probes: int) -> DataFrame:
    """A row for each bucket (table and signs in one number) that a vector is in, or is looked for in.

    A vector without a direction, or of another width, is in bucket -1, where no other vector is.
    """
    planes, bits = buckets.planes(), buckets.bits
    turned = min(bits, TURNED_BITS)  # signs that a probe may turn: those of the smallest projections
    flips = (np.arange(1 << turned)[:, None] >> np.arange(turned)) & 1 if probes > 1 else np.zeros((1, turned), np.int64)

    @F.pandas_udf("array<bigint>")
    def places(vectors: pd.Series) -> pd.Series:
        unit = _unit(vectors, buckets.width)
        lost = np.isnan(unit).any(axis=1)
        unit = np.nan_to_num(unit)
        found = []
        for t, plane in enumerate(planes):
            sides = unit @ plane
            code = (sides > 0) @ (1 << np.arange(bits, dtype=np.int64)) | (t << MOST_BITS)
            least = np.argsort(sides**2, axis=1, kind="stable")[:, :turned]
            cost = np.take_along_axis(sides**2, least, axis=1) @ flips.T
            near = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            masks = (flips[near] * (np.int64(1) << least)[:, None, :]).sum(axis=2)
            found.append(code[:, None] ^ masks)
        codes = np.concatenate(found, axis=1)
        return pd.Series([np.array([-1]) if no else own for own, no in zip(codes, lost)])

    return rows.withColumn("bucket", F.explode(places(vec)))


def search_buckets(store: DataFrame, queries: DataFrame, buckets: Buckets, k: int = V.TOP_K) -> DataFrame:
    """``search_many`` over the buckets that each query probes alone, with exact similarities.

    A crowded bucket is cut into blocks, each of which meets the bucket's queries in a group of its own.
    Queries that find fewer than k rows this way have fewer; ``recall`` tells what is missed.
    """
    asked, held = _sides(store, queries)
    held = _in_buckets(held, "held_vec", buckets, 1)
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "blocks", (F.floor(F.col("n") / STORE_BLOCK) + 1).cast("int")
    )
    block = F.pmod(F.xxhash64("held_id"), F.col("blocks")).cast("int")
    held = held.join(sizes, "bucket").withColumn("sb", block)
    asked = _in_buckets(asked, "asked_vec", buckets, buckets.probes).join(sizes, "bucket").withColumn(
        "sb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    # Queries of a crowded bucket are dealt in blocks too, and its rows meet each of them.
    query_blocks = _blocks(queries, QUERY_BLOCK)
    asked = asked.withColumn("qb", _block("asked_id", query_blocks)).drop("n", "blocks")
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).drop("n", "blocks")
    found = _best_of_groups(asked, held, ["bucket", "qb", "sb"], k)
    return _ranked(found.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results' (query_id, id) that were found; 1 where there is nothing to find."""
    wanted = exact.where("similarity IS NOT NULL").select("query_id", "id")
    hit = F.count("hit") / F.count(F.lit(1))
    marked = found.select("query_id", "id", F.lit(1).alias("hit"))
    return float(wanted.join(marked, ["query_id", "id"], "left").agg(F.coalesce(hit, F.lit(1.0))).first()[0])


def fitted_buckets(
    store: DataFrame, queries: DataFrame, k: int = V.TOP_K, least: float = 0.9, exact: DataFrame | None = None
) -> tuple[Buckets, float]:
    """Buckets whose measured recall on these queries reaches ``least``, and that recall.

    Probing widens until it does; at the last a query probes everything, which is the exact search.
    """
    exact = written(search_many(store, queries, k) if exact is None else exact, "exact-hits")
    buckets = buckets_for(store)
    while True:
        found = recall(search_buckets(store, queries, buckets, k), exact)
        if found >= least or not buckets.bits:
            return buckets, found
        buckets = buckets.wider()


def without_metadata(store: DataFrame, key: str, value: str) -> DataFrame:
    """Rows left after deleting those whose metadata has the value."""
    if not _METADATA_KEY.match(key):
        raise ValueError(f"Invalid metadata key: {key}")
    held = F.try_element_at("metadata", F.lit(key))
    return store.where(held.isNull() | (held != value))


def context(found: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Context block per query: the found chunks in rank order. At most k rows per group."""
    part = F.concat(
        F.lit("[Source: "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.col("content")
    )
    ranked = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return found.groupBy(*by).agg(
        F.array_join(F.transform(ranked, lambda r: r["part"]), V.CONTEXT_SEPARATOR).alias("context")
    )


def or_no_context(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context", F.coalesce("context", F.lit(V.NO_CONTEXT)))


def fleet_text(fleet: DataFrame) -> DataFrame:
    """One line on the fleet: size, average quality, average download rate."""
    stats = fleet.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("qoe_composite_latest").alias("qoe"),
        F.avg("dl_mbps_latest").alias("dl"),
    )
    line = F.concat(
        F.lit("Fleet size: "), F.col("n").cast("string"), F.lit(" devices. Average QoE: "),
        fixed_text(F.coalesce("qoe", F.lit(0.0)), 1), F.lit("/100. Average download: "),
        fixed_text(F.coalesce("dl", F.lit(0.0)), 0), F.lit(" Mbps."),
    )
    return settled(stats).select(F.when(F.col("n") > 0, line).otherwise(V.NO_FLEET).alias("text"))


def fleet_prompt(summary: DataFrame) -> DataFrame:
    """Fleet prompt from (text, context)."""
    body = F.concat("text", F.lit("\n\n"), "context")
    return summary.select(F.format_string(V.FLEET_PROMPT, body).alias("prompt"))


def with_system(prompts: DataFrame, product: str) -> DataFrame:
    """Add the ``system`` text that goes before every prompt; ``product`` names the fleet's software."""
    return prompts.withColumn("system", F.format_string(V.SYSTEM_PROMPT, F.lit(product)))


def question_prompt(rows: DataFrame) -> DataFrame:
    """Add the prompt of each question (question, context)."""
    return rows.withColumn("prompt", F.format_string(V.QUESTION_PROMPT, F.col("context"), F.col("question")))


def device_prompt(rows: DataFrame) -> DataFrame:
    """(device_id, prompt) from scores, metrics, top_features and context of each device."""
    line = F.transform(
        "top_features",
        lambda f: F.concat(
            F.lit("- "), f["name"], F.lit(": value="), fixed_text(f["value"], 2),
            F.lit(", z-score="), fixed_text(f["zscore"], 2),
        ),
    )
    top = F.when(F.size("top_features") > 0, F.array_join(line, "\n")).otherwise("No anomaly data available.")

    # Column and decimals of each number of the prompt, in its order.
    slots = [
        ("anomaly_score", 2),
        ("churn_risk", 0),
        ("qoe_composite_latest", 0),
        ("dl_mbps_latest", 0),
        ("ul_mbps_latest", 0),
        ("latency_idle_ms", 1),
    ]
    filled = settled(rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n, _ in slots}))
    numbers = [round_even(F.col(n), digits) for n, digits in slots]
    return filled.select(
        "device_id", F.format_string(V.DEVICE_PROMPT, F.col("device_id"), *numbers, top, F.col("context")).alias("prompt")
    )
