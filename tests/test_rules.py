"""Alerts, diagnosis, planning, decisions, registry, text and vector operators."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlight.functions import text
from meshlight.functions.vectors import unit
from meshlight.operators import alerts, documents, registry, remediation

SCANNED = "device_id string, anomaly_score double, wifi_pct_2_4ghz double, top_features array<struct<name: string, value: double, zscore: double>>"


def scan(spark, *rows):
    data = [(f"d{i}", score, share, [(n, 1.0, z) for n, z in top]) for i, (score, share, top) in enumerate(rows)]
    return spark.createDataFrame(data, SCANNED)


def test_diagnosis_and_plan(spark):
    rows = scan(
        spark,
        (0.85, 0.3, [("dl_bloat_pct", 3.5), ("latency_idle_ms", 1.0)]),
        (0.6, 0.75, [("wifi_client_count", 1.0)]),
        (0.3, 0.2, [("dl_mbps_latest", 0.5)]),
        (0.7, 0.3, [("wifi_avg_rssi", 2.5)]),
        (0.9, 0.1, [("a", 9.0), ("b", 1.5), ("c", 1.6), ("latency_idle_ms", 1.9)]),
        (0.9, None, []),
    )
    done = remediation.route(remediation.plan(remediation.diagnose(rows)), auto_enabled=True).orderBy("device_id").collect()
    assert [r.diagnosis for r in done] == ["bufferbloat", "band_congestion", "none", "weak_wifi_signal", "degraded_general", "none"]
    assert [r.action for r in done] == ["enable_sqm", "band_steering", None, "mesh_ap_add", "service_tier_change", None]
    assert [r.auto for r in done] == [True, True, None, False, False, None]
    assert [r.route for r in done] == ["execute", "escalate", "end", "escalate", "escalate", "end"]
    assert done[0].confidence == 0.85 and done[5].status == "failed"
    quiet = remediation.route(remediation.plan(remediation.diagnose(rows))).where("device_id = 'd0'").first()
    assert quiet.route == "escalate"


def test_rules_ignore_missing_and_unknown(spark):
    rows = spark.createDataFrame([("a", 40.0, None), ("b", 60.0, 600.0)], "device_id string, qoe_composite_latest double, dl_bloat_pct double")
    fired = alerts.alert_text(alerts.evaluate(rows)).collect()
    assert sorted((r.device_id, r.rule_id) for r in fired) == [
        ("a", "qoe_critical"), ("a", "qoe_warning"), ("b", "bloat_critical"), ("b", "bloat_warning"), ("b", "qoe_warning"),
    ]
    assert next(r.text for r in fired if r.rule_id == "bloat_critical") == "dl_bloat_pct=600.0 gt 500.0"
    custom = [("x", "X", "dl_bloat_pct", "near", 1.0, "info", "low"), ("y", "Y", "dl_bloat_pct", "gte", 600.0, "info", "low")]
    assert [r.rule_id for r in alerts.evaluate(rows, custom).collect()] == ["y"]


def test_verification_is_strictly_later(spark):
    runs = spark.createDataFrame([("r1", "d", "2024-01-01 10:00:00", 0.9), ("r2", "d", "2024-01-03 10:00:00", 0.9), ("r3", "e", "2024-01-01 00:00:00", 0.5)],
                                 "id string, device_id string, completed_at string, anomaly_score double")
    scores = spark.createDataFrame([("d", "2024-01-01 10:00:00", 0.1), ("d", "2024-01-02 09:00:00", 0.95), ("d", "2024-01-02 10:00:00", 0.2)],
                                   "device_id string, ts string, score double")
    found = remediation.verified(runs.withColumn("completed_at", F.col("completed_at").cast("timestamp")), scores.withColumn("ts", F.col("ts").cast("timestamp")))
    assert {r.id: (r.after, r.verified) for r in found.collect()} == {"r1": (0.95, False), "r2": (None, False), "r3": (None, False)}


def test_registry_moves_the_flag(spark):
    log = spark.createDataFrame(
        [("m", "1", 1, True), ("m", "2", 2, True), ("m", "3", 3, False), ("n", "1", 1, False)], "name string, version string, trained_at int, activate boolean"
    )
    assert [(r.name, r.version) for r in registry.active_versions(log).collect()] == [("m", "2")]
    one = {r.name: (r.active_version, r.version) for r in registry.one_per_name(log).collect()}
    assert one == {"m": ("2", "2"), "n": (None, "1")}


def plain_chunks(body, limit):
    """The chunking rules as a plain fold."""
    done, current = [], ""
    close = lambda: done.append(current.strip()) if current else None
    for block in (p.strip() for p in body.split("\n\n")):
        if not block:
            continue
        if len(current) + len(block) + 2 <= limit:
            current = current + "\n\n" + block if current else block
            continue
        close()
        if len(block) <= limit:
            current = block
            continue
        current = ""
        for piece in block.replace(". ", ".\n").split("\n"):
            if len(current) + len(piece) + 1 <= limit:
                current = current + " " + piece if current else piece
            else:
                close()
                current = piece
    close()
    return [c for c in done if c]


def random_text(rng):
    word = lambda: rng.choice(["a", "bb", "ccc", "déjà", "x" * 30, "ü. ", "\n", "\n\n", "\n\n\n", ". ", "  ", "\t", "."])
    return "".join(word() + rng.choice(["", " "]) for _ in range(rng.randint(0, 120)))


def test_chunks_match_plain_fold(spark):
    rng = random.Random(9)
    texts = ["", "   ", "a" * 600, "a. " + "b" * 600 + ". c\n\nd"] + [random_text(rng) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (20, 64):
        for r in rows.select("i", text.chunks(F.col("t"), limit).alias("c")).collect():
            assert r.c == plain_chunks(texts[r.i], limit), (limit, texts[r.i])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n", max_size=80), min_size=1, max_size=8))
def test_chunks_lose_no_letters(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.chunks(F.col("t"), 16).alias("c"))
    for r in rows.collect():
        keep = lambda s: [c for c in s if c in "ab."]
        assert keep("".join(r.c)) == keep(texts[r.i])


def test_chunk_ids(spark):
    body = "x" * 60
    row = documents.chunked(spark.createDataFrame([("f.md", body)], "s string, t string"), "s", "t").first()
    assert row.id == hashlib.sha256(f"f.md:0:{body[:50]}".encode()).hexdigest()[:16]


def vector_rows(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[5] = x[6]
    data = [(i, [float(v) for v in row], {"source": "s" if i % 2 else "t"}) for i, row in enumerate(x)]
    return x.astype(np.float64), spark.createDataFrame(data, "id bigint, embedding array<float>, metadata map<string,string>")


def test_search_matches_brute_force(spark, monkeypatch):
    x, store = vector_rows(spark, 300)
    norms = np.linalg.norm(x, axis=1)
    sims = (x @ x.T) / norms[:, None] / norms[None, :]

    def nearest(i, allowed=None):
        order = sorted((j for j in range(len(x)) if allowed is None or j % 2 == allowed), key=lambda j: (-round(sims[i, j], 9), j))
        return order[:5]

    assert [r.id for r in documents.search(store, x[0]).collect()] == nearest(0)
    assert [r.id for r in documents.search(store, x[0], metadata={"source": "t"}).collect()] == nearest(0, 0)
    queries = store.select(F.col("id").alias("query_id"), "embedding").where("query_id < 40")
    # Queries taken from the store itself, from a part of it, and from elsewhere; blocks of several sizes.
    apart = spark.createDataFrame(queries.collect(), queries.schema)
    for block, held in ((2048, 8192), (7, 50)):
        monkeypatch.setattr(documents, "QUERY_BLOCK", block)
        monkeypatch.setattr(documents, "STORE_BLOCK", held)
        for asked, rows in ((queries, store.repartition(5)), (queries, store), (apart, store.where("id >= 0"))):
            found = {}
            for r in documents.search_many(rows, asked).orderBy("query_id", "rank").collect():
                found.setdefault(r.query_id, []).append(r.id)
            assert len(found) == 40 and all(set(found[i]) == set(nearest(i)) for i in found)
    with pytest.raises(ValueError):
        documents.search(store, x[0], metadata={"bad key": "x"})
    assert documents.without_metadata(store, "source", "t").count() == 150


def test_bucket_search(spark, monkeypatch):
    """Clustered vectors: few buckets hold the nearest rows, and similarities are the exact ones."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(4000, [0.0] * 16), (4001, None), (4002, rows[7][1]), (4003, rows[7][1])]
    store = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(6).cache()
    queries = store.where("id % 100 = 7 OR id >= 4000").select(F.col("id").alias("query_id"), "embedding")
    monkeypatch.setattr(documents, "STORE_BLOCK", 300)
    exact = documents.search_many(store, queries).cache()
    buckets, found = documents.fitted_buckets(store, queries, least=0.9, exact=exact)
    assert found >= 0.9 and buckets.bits > 0
    near = documents.search_buckets(store, queries, buckets)
    truth = {(r.query_id, r.id): r.similarity for r in exact.collect() if r.similarity is not None}
    both = [(r.similarity, truth[r.query_id, r.id]) for r in near.collect() if (r.query_id, r.id) in truth]
    assert len(both) >= 0.9 * len(truth) and all(abs(a - b) < 1e-12 for a, b in both)
    assert [(r.rank, r.id) for r in near.where("query_id = 4002 AND rank <= 3").orderBy("rank").collect()] == [(1, 7), (2, 4002), (3, 4003)]
    # Each query looks into a small part of the store.
    asked = documents._in_buckets(queries.where("query_id < 4000"), "embedding", buckets, buckets.probes).select("query_id", "bucket")
    held = documents._in_buckets(store, "embedding", buckets, 1).select("id", "bucket")
    assert asked.join(held, "bucket").select("query_id", "id").distinct().count() < 0.5 * 40 * 4000
    # At the widest every row is looked at, and the search is the exact one.
    whole = documents.Buckets(16, 0)
    assert documents.recall(documents.search_buckets(store, queries, whole), exact) == 1.0
    empty = store.limit(0)
    assert documents.search_buckets(empty, queries, documents.buckets_for(empty)).count() == 0
    assert documents.search_many(empty, queries).count() == 0


def test_upsert_and_unit(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, created_at int, content string")
    assert {r.id: r.content for r in documents.upserted(rows).collect()} == {"a": "z", "b": "q"}
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(unit(F.col("v")).alias("v"), unit(F.col("z")).alias("z")).first()
    assert row.v == [0.6, 0.8] and row.z == [0.0, 0.0]


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "s2", "b"), (1, 1, "s1", "a")], "query_id int, rank int, source string, content string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    blocks = documents.or_no_context(asked.join(documents.context(hits), "query_id", "left"))
    got = {r.query_id: r.context for r in blocks.collect()}
    assert got == {1: "[Source: s1]\na\n\n---\n\n[Source: s2]\nb", 2: "No relevant documentation found."}


def test_outbox_follows_impact(spark):
    recs = spark.createDataFrame(
        [("1", "d", i, "bufferbloat", "T", 0.855) for i in ("high", "medium", "low", "odd")],
        "id string, device_id string, impact string, diagnosis string, title string, confidence double",
    )
    got = sorted((r.impact, r.channel) for r in remediation.outbox(recs).collect())
    assert got == [("high", "email"), ("high", "slack"), ("medium", "slack")]


def test_device_prompts_have_their_own_context(spark):
    from meshlight.plans import jobs

    scored = spark.createDataFrame(
        [(d, 0.5, 50.0, 10.0, 1.0, 9.0, []) for d in ("a", "b", "c", "d")],
        "device_id string, anomaly_score double, qoe_composite_latest double, dl_mbps_latest double, ul_mbps_latest double, "
        "latency_idle_ms double, top_features array<struct<name: string, value: double, zscore: double>>",
    )
    risk = spark.createDataFrame([("a", 5.0)], "device_id string, risk_score double")
    store = spark.createDataFrame(
        [("1", "wifi", "about wifi", [1.0, 0.0]), ("2", "bloat", "about bloat", [0.0, 1.0])],
        "id string, source string, content string, embedding array<double>",
    )
    asked = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("c", [0.1, 1.0]), ("d", None)], "device_id string, embedding array<double>")
    prompts = {r.device_id: r.prompt for r in jobs.device_prompts(scored, risk, store, asked, 1).collect()}
    held = {d: [t for t in ("about wifi", "about bloat") if t in p] for d, p in prompts.items()}
    assert held == {"a": ["about wifi"], "b": ["about bloat"], "c": ["about bloat"], "d": []}
