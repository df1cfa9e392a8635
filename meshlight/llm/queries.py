"""The registered queries of the operators, ``opN_<name>``, over the whole given tables.

Every query applies its operator to all rows and derives the columns its users compare from the
operator's own output. Only ``op9`` can be said in SQL; the others are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.llm import (
    alignment, extraction, licenses, lm, mixing, order_minhash, packing, pii, quality, simhash, toxicity, url_filters, whitening,
)
from meshlight.session import tuned, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The settings that all queries of the library share; nothing is set for these alone."""
    return tuned(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two integers per rule and row, read twice: by the fit and by the verdicts.
    signalled = written(quality.signals(table(spark, sf_dir, "documents"), keep=["doc_id"]), "quality-signals")
    judged = quality.judged(signalled, quality.fit(signalled))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = written(simhash.fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]), "simhash")
    return simhash.linked(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = extraction.extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return extracted.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies"
    )


# The tables hold no filter lists and no fetch times: both are derived from the pages, by hashes of
# their urls. Every host, every host with its first segment, and every sixth url's host with two
# segments is entered into some list, with up to three dated changes.
_DAY0 = 1_600_000_000
_DAYS = 730
_LISTS = (("adult", "block"), ("malware", "block"), ("spam", "block"), ("trusted", "allow"))


def number(text: Column) -> Column:
    """A number below 2^32 from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seed = F.concat(F.lit("fetch|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return pages.withColumn("fetched", F.lit(_DAY0) + F.pmod(number(seed), F.lit(_DAYS * 86_400)))


def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("url").distinct()
    host, segments = url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))
    one = F.concat_ws("/", host, F.get(segments, F.lit(0)))
    two = F.concat_ws("/", host, F.get(segments, F.lit(0)), F.get(segments, F.lit(1)))
    candidates = F.array(
        host, F.when(F.size(segments) >= 1, one),
        F.when((F.size(segments) >= 2) & (F.pmod(number(F.col("url")), F.lit(6)) == 0), two),
    )
    patterns = urls.where(host != "").select(F.explode(candidates).alias("pattern")).where("pattern IS NOT NULL").distinct()
    names = F.array(*[F.struct(F.lit(n).alias("list"), F.lit(k).alias("kind")) for n, k in _LISTS])
    entered = patterns.withColumn("of", F.explode(names)).select("pattern", "of.list", "of.kind")
    turns = entered.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "n", number(F.concat_ws("|", "list", "pattern", F.col("turn").cast("string")))
    )
    return turns.where("n % 5 < 2").select(
        "list", "kind", "pattern", (F.lit(_DAY0) + F.floor(F.col("n") / 5) % _DAYS * 86_400).alias("at"),
        F.when(F.col("turn") == 1, "remove").otherwise("add").alias("action"),
    )


_OP9_SQL = f"""
WITH page AS (SELECT page_id, url, {_DAY0} + CAST('0x' || md5('fetch|' || coalesce(CAST(page_id AS VARCHAR), ''))[1:8] AS BIGINT)
    % {_DAYS * 86_400} AS fetched FROM pages),
parts AS (SELECT DISTINCT url, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\\.$', '') AS host,
    [s FOR s IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/') IF s <> ''] AS seg
    FROM pages WHERE url IS NOT NULL),
pattern AS (SELECT host AS pattern FROM parts WHERE host <> '' UNION SELECT host || '/' || seg[1] FROM parts WHERE host <> '' AND len(seg) >= 1
    UNION SELECT host || '/' || seg[1] || '/' || seg[2] FROM parts
    WHERE host <> '' AND len(seg) >= 2 AND CAST('0x' || md5(url)[1:8] AS BIGINT) % 6 = 0),
turn AS (SELECT list, kind, pattern, turn, CAST('0x' || md5(list || '|' || pattern || '|' || turn)[1:8] AS BIGINT) AS n
    FROM pattern, (VALUES {", ".join(f"('{n}', '{k}')" for n, k in _LISTS)}) AS l(list, kind), (VALUES (0), (1), (2)) AS t(turn)),
change AS (SELECT DISTINCT list, kind, pattern, {_DAY0} + (n // 5) % {_DAYS} * 86400 AS since,
    CASE WHEN turn = 1 THEN 'remove' ELSE 'add' END AS action FROM turn WHERE n % 5 < 2),
entry AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since, action) AS until FROM change)
    WHERE action = 'add' AND (until IS NULL OR until > since)),
hit AS (SELECT page_id, p.url, fetched, list, kind, pattern FROM page p JOIN parts u ON p.url = u.url JOIN entry e
    ON since <= fetched AND (until IS NULL OR until > fetched) AND (host = pattern OR ends_with(host, '.' || pattern)
    OR starts_with(host || '/' || array_to_string(seg, '/') || '/', pattern || '/'))),
verdict AS (SELECT page_id, url, fetched, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    max({{'a': length(pattern), 'b': kind = 'allow', 'c': pattern}}) AS top FROM hit GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, top.c AS pattern,
    coalesce(NOT top.b, false) AS blocked
FROM page p LEFT JOIN verdict v ON p.page_id IS NOT DISTINCT FROM v.page_id AND p.url = v.url AND p.fetched = v.fetched
"""


@query("op9_url_filters", _OP9_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filtered(captures(spark, sf_dir), list_changes(spark, sf_dir)).select(
        "page_id", "url", "fetched", "n_active", "lists", "pattern", "blocked"
    )


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.followed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    model = lm.train(documents.where(~F.col("held_out")))
    return lm.scored(documents, model, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op4_license_scans")
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").alias("n_spans"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.train(documents, labels)
    return toxicity.scored(documents, model, keep=["doc_id"]).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained()]).cast("array<double>")
    return whitening.whitened(vectors, model, keep=["vec_id"]).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.size(pii.of_kind(F.col("found"), [k])).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    base = pii.written_out(pii.of_kind(F.col("found"), pii.BASE))
    return rows.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.written_out(F.col("found")).alias("spans")
    )


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe(), keep=["doc_id"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
