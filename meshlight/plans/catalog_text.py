"""Queries over documents and embeddings: chunks, upserts, cosine search, context, prompts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight import values as V
from meshlight.functions.vectors import norm, unit
from meshlight.operators import documents
from meshlight.plans import jobs
from meshlight.plans.catalog import EV, FLEET, SNAP, query, rounded
from meshlight.plans.catalog_models import ALIGNED, RANKED, RISK_SQL, SCORED_SQL, STATS, merged, stand_in_risk
from meshlight.plans.catalog_rules import explained
from meshlight.session import written
from meshlight.sources import tables as T

_STRIP = "regexp_replace({}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"
_DONE = "CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, " + _STRIP.format("a.open") + ") END"
# Every document of the table is one paragraph; blank-line packing is tested against a plain fold.
CHUNKS = (
    "para AS (SELECT doc_id, source, " + _STRIP.format("text") + " AS body FROM documents), "
    "folded AS (SELECT doc_id, CASE WHEN length(body) <= 512 THEN {'done': CAST([] AS VARCHAR[]), 'open': body} ELSE list_reduce("
    "list_prepend({'done': CAST([] AS VARCHAR[]), 'open': ''}, list_transform(string_split(replace(body, '. ', '.' || chr(10)), chr(10)), "
    "lambda s: {'done': CAST([] AS VARCHAR[]), 'open': s})), lambda a, b: CASE WHEN length(a.open) + length(b.open) + 1 <= 512 "
    "THEN {'done': a.done, 'open': CASE WHEN a.open = '' THEN b.open ELSE a.open || ' ' || b.open END} "
    "ELSE {'done': " + _DONE + ", 'open': b.open} END) END AS a FROM para), "
    "lists AS (SELECT doc_id, list_filter(" + _DONE + ", lambda c: c <> '') AS parts FROM folded), "
    "chunks AS (SELECT CAST(doc_id AS VARCHAR) AS source, CAST(i AS INTEGER) AS chunk_index, parts[i + 1] AS content, "
    "substr(sha256(doc_id || ':' || i || ':' || substr(parts[i + 1], 1, 50)), 1, 16) AS id "
    "FROM (SELECT *, unnest(range(len(parts))) AS i FROM lists))"
)


@query("document_chunks", CHUNKS, sql="SELECT source, chunk_index, id, content FROM chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunked(T.read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "conversation_chunks",
    sql="""SELECT conv_id, turn, role, substr(sha256(concat_ws(':', 'device', conv_id || '/' || turn, substr(text, 1, 50))), 1, 16) AS id
      FROM conversations""",
)
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of single devices or sessions keep their id over chunk 0: one row per turn."""
    return T.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", documents.device_summary_id(F.concat_ws("/", "conv_id", "turn"), F.col("text")).alias("id")
    )


def _written_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select(
        F.col("source").alias("id"), "doc_id", F.sha2("text", 256).alias("content"),
        F.timestamp_seconds(F.col("doc_id")).alias("created_at"),
    )


@query(
    "chunk_upsert",
    sql="SELECT source AS id, max(doc_id) AS doc_id, arg_max(sha256(text), doc_id) AS content FROM documents GROUP BY 1",
)
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.upserted(_written_docs(spark, sf_dir)).drop("created_at")


# ----------------------------------------------------------------------------------------- vectors


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    rows = T.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    vectors = rows.select(F.col("label").cast("bigint").alias("query_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return vectors.groupBy("query_id").agg(Summarizer.mean(F.col("v")).alias("m")).select(
        "query_id", vector_to_array("m").alias("embedding")
    )


QUERY_SQL = (
    "asked AS (SELECT label AS query_id, list(m ORDER BY p) AS q FROM (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS m "
    "FROM embeddings, range(1, 65) t(p) GROUP BY 1, 2) GROUP BY 1), "
    "sims AS (SELECT query_id, vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity "
    "FROM embeddings, asked), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims)"
)


def _first_query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(label_queries(spark, sf_dir).where("query_id = 0").first()["embedding"])


@query(
    "cosine_search", QUERY_SQL,
    sql="SELECT id, round(similarity, 6) AS similarity FROM top WHERE query_id = 0 AND rank <= 5",
)
def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.search(vector_store(spark, sf_dir), _first_query(spark, sf_dir))
    return rounded(found.select("id", "similarity"), 6)


@query(
    "cosine_search_filtered", QUERY_SQL,
    sql="""SELECT id, round(similarity, 6) AS similarity FROM sims WHERE query_id = 0 AND label = 3
      ORDER BY sims.similarity DESC, id LIMIT 5""",
)
def cosine_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.search(vector_store(spark, sf_dir), _first_query(spark, sf_dir), metadata={"label": "3"})
    return rounded(found.select("id", "similarity"), 6)


@query(
    "cosine_search_batch", QUERY_SQL,
    sql="""SELECT CAST(query_id AS BIGINT) AS query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
      FROM top WHERE rank <= 5""",
)
def cosine_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(documents.search_many(vector_store(spark, sf_dir), label_queries(spark, sf_dir)), 6)


@query(
    "approximate_search",
    "unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
    "ranked AS (SELECT q.vec_id AS query_id, s.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    "list_cosine_similarity(q.e, s.e) DESC, s.vec_id) AS rank FROM unit q, unit s WHERE q.vec_id % 100 = 0)",
    sql="SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS recall_reached FROM ranked WHERE rank <= 5",
)
def approximate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the bucket search against the exact one: ids divisible by 100 against all rows."""
    store = vector_store(spark, sf_dir)
    asked = written(store.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), "queries")
    exact = written(documents.search_many(store, asked), "exact-hits")
    _, found = documents.fitted_buckets(store, asked, least=0.9, exact=exact)
    return exact.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted")).withColumn(
        "recall_reached", F.lit(found >= 0.9)
    )


@query("chunk_count", sql="SELECT count(*) AS rows FROM embeddings")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_store(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))


@query("chunk_delete", sql="SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def chunk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.without_metadata(vector_store(spark, sf_dir), "label", "3").select("id")


@query(
    "unit_vectors",
    "n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings)",
    sql="""SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first,
      round(e[64] / sqrt(list_dot_product(e, e)), 6) AS last, CAST(1 AS DOUBLE) AS length,
      round(list_dot_product(e, list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))) / sqrt(list_dot_product(e, e)), 5) AS digest FROM n""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e")
    )
    scaled = rows.select("vec_id", unit(F.col("e")).alias("u"))
    # Every component counts in the digest, by its place.
    placed = F.transform("u", lambda x, i: x * (i + 1))
    digest = F.round(F.aggregate(placed, F.lit(0.0), lambda t, x: t + x), 5)
    return rounded(
        scaled.select(
            "vec_id", F.get("u", F.lit(0)).alias("first"), F.get("u", F.lit(63)).alias("last"), norm(F.col("u")).alias("length"),
            digest.alias("digest"),
        ),
        6,
    )


# -------------------------------------------------------------------------------- context, prompts


def text_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding, as stored chunks."""
    docs = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    # A document without a vector stays in the store; it is found last.
    return docs.join(vector_store(spark, sf_dir), "id", "left")


CONTEXT_SQL = (
    "stored AS (SELECT query_id, top.id, similarity, source, text FROM top JOIN documents ON doc_id = top.id), "
    "found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM stored), "
    "ctx AS (SELECT query_id, string_agg('[Source: ' || source || ']' || chr(10) || text, "
    "chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM found WHERE place <= 5 GROUP BY 1)"
)


@query(
    "context_blocks", QUERY_SQL, CONTEXT_SQL,
    sql="SELECT CAST(query_id AS BIGINT) AS query_id, length(context) AS chars, sha256(context) AS digest FROM ctx",
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = text_store(spark, sf_dir)
    asked = label_queries(spark, sf_dir)
    hits = documents.search_many(store, asked)
    # At most k hits per query: the texts are fetched for these alone.
    found = hits.join(store.select("id", "source", "content"), "id")
    blocks = asked.select("query_id").join(documents.context(found), "query_id", "left")
    return documents.or_no_context(blocks).select(
        "query_id", F.length("context").cast("bigint").alias("chars"), F.sha2("context", 256).alias("digest")
    )


FLEET_TEXT = (
    "line AS (SELECT 'Fleet size: ' || count(*) || ' devices. Average QoE: ' || printf('%.1f', avg(qoe_composite_latest)) || "
    "'/100. Average download: ' || printf('%.0f', avg(dl_mbps_latest)) || ' Mbps.' AS text FROM fleet)"
)


@query("fleet_text", EV, SNAP, FLEET, FLEET_TEXT, sql="SELECT text FROM line")
def fleet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fleet_text(merged(spark, sf_dir))


_FLEET_HEAD, _FLEET_TAIL = V.FLEET_PROMPT.split("%s")


@query(
    "fleet_prompt", EV, SNAP, FLEET, FLEET_TEXT, QUERY_SQL, CONTEXT_SQL,
    sql=f"""SELECT sha256('{_FLEET_HEAD}' || text || chr(10) || chr(10) || context || '{_FLEET_TAIL}') AS digest
      FROM line, ctx WHERE query_id = 0""",
)
def fleet_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = text_store(spark, sf_dir)
    asked = label_queries(spark, sf_dir).where("query_id = 0")
    found = documents.search_many(store, asked).join(store.select("id", "source", "content"), "id")
    text = documents.fleet_text(merged(spark, sf_dir)).withColumn("context", documents.context(found).select("context").scalar())
    return documents.fleet_prompt(documents.or_no_context(text)).select(F.sha2("prompt", 256).alias("digest"))


_QUESTION = V.QUESTION_PROMPT.replace("'", "''").split("%s")


@query(
    "question_prompts", QUERY_SQL, CONTEXT_SQL,
    sql=f"""SELECT CAST(query_id AS BIGINT) AS query_id, sha256('{_QUESTION[0]}' || context || '{_QUESTION[1]}' ||
      'What is wrong with group ' || query_id || '?' || '{_QUESTION[2]}') AS digest,
      sha256('{V.SYSTEM_PROMPT.replace("%s", "example")}') AS system FROM ctx""",
)
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A technician's question about every label, with the texts nearest to it."""
    store = text_store(spark, sf_dir)
    asked = label_queries(spark, sf_dir)
    found = documents.search_many(store, asked).join(store.select("id", "source", "content"), "id")
    question = F.concat(F.lit("What is wrong with group "), F.col("query_id").cast("string"), F.lit("?"))
    rows = documents.or_no_context(asked.select("query_id").join(documents.context(found), "query_id", "left"))
    prompts = documents.with_system(documents.question_prompt(rows.withColumn("question", question)), "example")
    return prompts.select("query_id", F.sha2("prompt", 256).alias("digest"), F.sha2("system", 256).alias("system"))


def _device_prompt_sql() -> str:
    parts = V.DEVICE_PROMPT.replace("'", "''").split("%")
    slots = [
        ("device_id", "s"), ("printf('%.2f', anomaly_score)", ".2f"), ("printf('%.0f', risk_score)", ".0f"),
        ("printf('%.0f', coalesce(qoe_composite_latest, 0))", ".0f"), ("printf('%.0f', coalesce(dl_mbps_latest, 0))", ".0f"),
        ("printf('%.0f', coalesce(ul_mbps_latest, 0))", ".0f"), ("printf('%.1f', coalesce(latency_idle_ms, 0))", ".1f"),
        ("lines", "s"), ("context", "s"),
    ]
    text = f"'{parts[0]}'"
    for part, (value, form) in zip(parts[1:], slots, strict=True):
        text += f" || {value} || '{part.removeprefix(form)}'"
    return text


@query(
    "device_prompts", EV, SNAP, FLEET, ALIGNED, STATS, SCORED_SQL, RANKED, RISK_SQL, QUERY_SQL, CONTEXT_SQL,
    "tops AS (SELECT device_id, string_agg('- ' || name || ': value=' || printf('%.2f', value) || ', z-score=' || "
    "printf('%.2f', zscore), chr(10) ORDER BY rank) AS lines FROM ranked WHERE rank <= 5 GROUP BY 1)",
    sql=f"""SELECT device_id, sha256({_device_prompt_sql()}) AS digest FROM scored JOIN risk USING (device_id)
      JOIN tops USING (device_id), (SELECT context FROM ctx WHERE query_id = 0)""",
)
def device_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no vectors of the devices' questions: every device asks with that of label 0."""
    scored = explained(spark, sf_dir)
    first = F.array(*[F.lit(x) for x in _first_query(spark, sf_dir)])
    asked = scored.select("device_id", first.alias("embedding"))
    rows = jobs.device_prompts(scored, stand_in_risk(spark, sf_dir), text_store(spark, sf_dir), asked)
    return rows.select("device_id", F.sha2("prompt", 256).alias("digest"))
