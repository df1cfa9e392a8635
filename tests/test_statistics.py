"""Temporal, ranking, drift and rounding operators against plain Python on small inputs."""

import collections
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshlight.functions.rounding import fixed_text, round_even
from meshlight.operators import churn, drift, ordering, partials, segments, temporal

START = datetime(2024, 1, 1)


def make_series(seed, devices=4, days=12):
    rng = random.Random(seed)
    rows = []
    for d in range(devices):
        at = START
        for _ in range(rng.choice([1, 2, 40, 120])):
            at += timedelta(seconds=rng.randint(1, days * 86400 // 60))
            rows.append((f"d{d}", at, rng.choice([None, float(rng.randint(0, 60)), rng.uniform(0, 99)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "device_id string, ts timestamp, value double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_window_statistics(spark, seed):
    rows = make_series(seed)
    data = frame(spark, rows)
    stats = {r.device_id: r for r in temporal.rolling_stats(data, window="24h").collect()}
    slopes = {r.device_id: r.slope for r in temporal.linear_trend(data, window="7d").collect()}
    below = {r.device_id: r.fraction_below for r in temporal.fraction_below(data, 30.0).collect()}
    drops = {r.device_id: r.drops for r in temporal.count_drops(data).collect()}
    for device, group in pd.DataFrame(rows, columns=["d", "ts", "v"]).groupby("d"):
        series = pd.Series(group["v"].to_numpy(dtype=float), index=pd.DatetimeIndex(group["ts"]))
        day = series[series.index > series.index[-1] - pd.Timedelta("24h")]
        got = stats[device]
        assert got["count"] == len(day)
        assert got["mean"] == pytest.approx(0.0 if day.isna().all() else day.mean())
        assert got["std"] == pytest.approx(day.std() if day.notna().sum() > 1 else 0.0)
        assert got["min"] == pytest.approx(0.0 if day.isna().all() else day.min())
        week = series[series.index > series.index[-1] - pd.Timedelta("7d")].dropna()
        t = (week.index - week.index[0]).total_seconds() / 86400 if len(week) else []
        expected = np.polyfit(t, week.to_numpy(), 1)[0] if len(week) > 1 else 0.0
        assert slopes[device] == pytest.approx(expected, rel=1e-6, abs=1e-6)
        assert below[device] == pytest.approx((series < 30).sum() / len(series))
        assert drops[device] == int((series.diff().dropna() < -10).sum())


def test_window_is_open_at_the_start(spark):
    rows = [("d", START, 1.0), ("d", START + timedelta(hours=24), 3.0)]
    assert temporal.rolling_stats(frame(spark, rows)).first()["count"] == 1


def test_bundle_drops_nulls_first(spark):
    rows = [("d", START + timedelta(hours=h), 5.0 if h < 3 else None) for h in range(100)] + [("e", START, None)]
    found = {r.device_id: r for r in temporal.bundle(frame(spark, rows), ["value"]).collect()}
    assert found["d"]["value_mean_24h"] == 5.0 and found["d"]["value_std_24h"] == 0.0 and found["d"]["value_trend_7d"] == 0.0
    assert found["e"]["value_mean_24h"] is None and found["e"]["value_trend_7d"] is None


def test_round_even(spark):
    rng = random.Random(5)
    values = [12.25, 12.35, 2.675, 0.125, -0.125, -2.5, 0.5, 1.5, 1e15, 0.0, -12.25] + [rng.uniform(-1e4, 1e4) for _ in range(300)]
    values += [round(rng.uniform(0, 100), 2) + 0.005 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = rows.select("v", *[round_even(F.col("v"), n).alias(f"r{n}") for n in (0, 1, 2, 3)], fixed_text(F.col("v"), 1).alias("t")).collect()
    for r in got:
        if r.v is None:
            assert r.r2 is None
            continue
        for n in (0, 1, 2, 3):
            assert r[f"r{n}"] == round(r.v, n), (r.v, n)
        if abs(r.v) < 1e6:
            assert float(r.t) == float(f"{r.v:.1f}")


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_and_row_numbers(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=700), np.full(400, 0.25), rng.integers(0, 5, 100)])
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(values)], "id int, g string, v double")
    probabilities = [0.0, 0.05, 0.333, 0.5, 0.9, 1.0]
    for r in ordering.quantiles(rows, "v", probabilities, ["g"]).collect():
        part = [v for i, v in enumerate(values) if (r.g == "a") == bool(i % 3)]
        assert np.allclose(r.quantiles, np.percentile(part, [p * 100 for p in probabilities]))
    numbered = ordering.row_numbers(rows, ["v", "id"]).orderBy("row_number").collect()
    assert [r.row_number for r in numbered] == list(range(1, len(values) + 1))
    assert [(r.v, r.id) for r in numbered] == sorted((float(v), i) for i, v in enumerate(values))


def plain_psi(ref, cur, bins=10):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, bins + 1)))
    if len(ref) == 0 or len(cur) == 0 or len(edges) < 2:
        return 0.0
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    r, c = (r + 1) / (len(ref) + bins), (c + 1) / (len(cur) + bins)
    return float(np.sum((c - r) * np.log(c / r)))


def test_drift(spark):
    rng = np.random.default_rng(3)
    ref = {"same": rng.normal(size=400), "moved": rng.normal(size=400), "tied": rng.integers(0, 3, 400).astype(float), "constant": np.ones(400)}
    cur = {"same": rng.normal(size=300), "moved": rng.normal(2, 1, 300), "tied": rng.integers(0, 4, 300).astype(float), "constant": np.ones(300)}
    to_frame = lambda data: spark.createDataFrame(pd.DataFrame(data))
    found = {r.feature: r for r in drift.report(to_frame(ref), to_frame(cur), list(ref)).collect()}
    for name in ref:
        both = np.sort(np.concatenate([ref[name], cur[name]]))
        gap = np.abs(np.searchsorted(np.sort(ref[name]), both, "right") / 400 - np.searchsorted(np.sort(cur[name]), both, "right") / 300).max()
        assert found[name].psi == pytest.approx(plain_psi(ref[name], cur[name]), abs=1e-4)
        assert found[name].ks_statistic == pytest.approx(gap, abs=1e-4)
    assert found["moved"].is_drifted and found["moved"].severity == "high" and not found["constant"].is_drifted
    assert found["constant"].psi == 0.0 and found["constant"].ks_p_value == 1.0
    none = drift.report(to_frame({"a": cur["same"]}).limit(0), to_frame({"a": cur["same"]}), ["a"]).first()
    assert (none.psi, none.ks_statistic, none.is_drifted) == (0.0, 0.0, False)
    few = drift.report(to_frame({"a": ref["same"][:4]}), to_frame({"a": cur["moved"][:200]}), ["a"]).first()
    assert (few.ks_statistic, few.ks_p_value) == (0.0, 1.0)


def test_ks_tail_is_continuous(spark):
    rows = spark.range(1, 400).select((F.col("id") / 200.0).alias("x"))
    tail = [r.p for r in rows.select(drift._ks_tail(F.col("x"), F.lit(1.0)).alias("p")).collect()]
    assert all(a >= b - 1e-9 for a, b in zip(tail, tail[1:])) and tail[0] == pytest.approx(1.0)
    assert tail[199] == pytest.approx(0.26999967, abs=1e-6)


def test_knee(spark):
    rng = np.random.default_rng(2)
    for values in ([1.0, 1.0, 1.0, 4.0], [1.0, 2.0], list(rng.integers(0, 9, 40).astype(float)), list(rng.uniform(size=50)), [2.0] * 5):
        got = segments.knee(spark.createDataFrame([(float(v),) for v in values], "distance double")).first().eps
        k = np.sort(values)
        expected = 0.5 if len(k) < 3 else k[np.argmax(np.diff(np.diff(k))) + 1]
        assert got == expected, values


def test_auc(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 20))) for _ in range(200)]
    got = churn.auc(spark.createDataFrame(rows, "label int, score double")).first().auc
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(wins / len(pos) / len(neg))
    assert churn.auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().auc is None


def test_folds(spark):
    for n in (8, 11):
        rows = churn.expanding_folds(spark.range(n).withColumnRenamed("id", "t"), ["t"]).orderBy("position").collect()
        size = n // 4
        starts = list(range(n - 3 * size, n, size))
        assert [r.test_fold for r in rows] == [sum(i >= s for s in starts) for i in range(n)]


def test_hot_value_is_one_row(spark):
    """A value shared by most rows is one row after the count, so ranking does not see the skew."""
    rows = spark.range(30000).select(F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert ordering.value_counts(rows, "v").count() == 10000 + (0 if 7 % 3 == 0 else 1)
    assert math.isclose(ordering.quantiles(rows, "v", [0.5]).first().quantiles[0], float(np.percentile(
        [7.0 if i % 3 else float(i) for i in range(30000)], 50)))


def test_ties_in_time_are_settled_by_the_data(spark):
    from meshlight.operators import documents, remediation, store

    rows = [("d", "2026-01-01 00:00:00", float(i), float(-i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "device_id string, ts string, a double, b double").withColumn("ts", F.col("ts").cast("timestamp"))
    shuffled = frame.orderBy(F.rand(1)).repartition(7)
    for run in (lambda f: store.fleet_latest(f, ["a", "b"]), lambda f: store.fleet_merged(f, ["a", "b"]), lambda f: store.latest_of(f, "d")):
        assert run(frame).collect() == run(shuffled).collect()
    newest = store.fleet_latest(frame, ["a", "b"]).first()
    assert newest.a == -newest.b  # both from one row
    log = frame.select(F.lit("x").alias("id"), F.col("ts").alias("decided_at"), F.col("a").cast("string").alias("status"), F.col("b").cast("string").alias("decided_by"))
    recs = spark.createDataFrame([("x", "pending")], "id string, status string")
    again = log.orderBy(F.rand(2)).repartition(5)
    assert remediation.decided(recs, log).collect() == remediation.decided(recs, again).collect()
    chunks = frame.select(F.lit("x").alias("id"), "a", "b", F.col("ts").alias("created_at"))
    assert documents.upserted(chunks).collect() == documents.upserted(chunks.repartition(6)).collect()


def test_search_of_vectors_without_direction(spark):
    from meshlight.operators import documents

    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8])], "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    got = [(r.query_id, r.rank, r.id, r.similarity) for r in documents.search_many(store, asked, 4).orderBy("query_id", "rank").collect()]
    assert [(q, i, s if s is None else round(s, 9)) for q, _, i, s in got] == [
        (7, 1, 1.0), (7, 4, 0.6), (7, 2, None), (7, 3, None), (8, 1, None), (8, 2, None), (8, 3, None), (8, 4, None),
    ]
    one = [(r.id, r.similarity) for r in documents.search(store, [1.0, 0.0], 4).collect()]
    assert [i for i, _ in one] == [1, 4, 2, 3] and one[2][1] is None


# ------------------------------------------------------------------------------ states and windows


def odd_series(spark, n=900, seed=7):
    """Readings of a busy, a quiet and a lone device: ties in time, nulls, large values with little spread."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = int(rng.integers(0, 40 * 3600)) * 1_000_000 + int(rng.integers(0, 3))
        rows.append(("busy", at, None if i % 17 == 0 else float(rng.normal(1e6, 1))))
    rows += [("busy", rows[5][1], 3.0), ("busy", rows[5][1], -3.0)]
    rows += [("quiet", 3_600_000_000 * h, float(h % 5)) for h in (0, 1, 9, 30)] + [("lone", 5, 2.5), ("empty", 7, None)]
    frame = spark.createDataFrame(rows, "device_id string, us bigint, value double")
    return rows, frame.select("device_id", F.timestamp_micros("us").alias("ts"), "value")


def test_trailing_windows_match_brute_force(spark):
    rows, frame = odd_series(spark)
    hours = 6
    got = {r.device_id: r for r in temporal.rolling_stats(frame.repartition(5), window=f"{hours}h").collect()}
    slopes = {r.device_id: r.slope for r in temporal.linear_trend(frame, window=f"{hours}h").collect()}
    for device in {r[0] for r in rows}:
        own = [(t, v) for d, t, v in rows if d == device]
        end = max(t for t, _ in own)
        inside = [(t, v) for t, v in own if t > end - hours * 3_600_000_000]
        x = np.array([v for _, v in inside if v is not None])
        r = got[device]
        assert r["count"] == len(inside)
        assert np.isclose(r["mean"], x.mean() if len(x) else 0, rtol=1e-14)
        assert np.isclose(r["std"], x.std(ddof=1) if len(x) > 1 else 0, rtol=1e-9)
        assert (r["min"], r["max"]) == ((x.min(), x.max()) if len(x) else (0, 0))
        days = np.array([t for t, v in inside if v is not None]) / 86_400e6
        want = np.polyfit(days - days.mean(), x - x.mean(), 1)[0] if len(set(days)) > 1 else 0.0
        assert np.isclose(slopes[device], want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize(("window", "length"), [(6, None), (6, 225_000_000), (1, None), (2, 3_600_000_000)])
def test_statistics_at_every_reading(spark, window, length):
    rows, frame = odd_series(spark, 300)
    got = partials.per_reading(frame, ["device_id"], "value", window * partials.HOUR, length).collect()
    assert len(got) == len(rows)
    found = sorted((r.device_id, int(r.ts.timestamp() * 1e6 + 0.5), r.value is None, r.value or 0.0, r["count"], r["mean"], r["std"], r["min"], r["max"]) for r in got)
    for (device, at, _, _, count, mean, std, low, high), (d, t, v) in zip(found, sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0))):
        assert (device, at) == (d, t)
        own = [x for e, s, x in rows if e == d and t - window * partials.HOUR < s <= t]
        x = np.array([y for y in own if y is not None])
        assert count == len(own) and (mean is None) == (not len(x))
        if len(x):
            assert np.isclose(mean, x.mean(), rtol=1e-13) and (low, high) == (x.min(), x.max())
            assert np.isclose(std, x.std(ddof=1) if len(x) > 1 else 0, rtol=1e-7, atol=1e-9)


def test_busy_chunks_are_cut(spark):
    rows, frame = odd_series(spark)
    most = 20
    length = partials.chunk_length(frame, ["device_id"], most=most)
    assert length < partials.HOUR and partials.HOUR % length == 0
    counts = collections.Counter((d, t - t % length) for d, t, _ in rows)
    assert max(counts.values()) <= most
    whole = {r.device_id: r.drops for r in temporal.count_drops(frame.where("value IS NOT NULL"), 0.5).collect()}
    cut = {r.device_id: r.drops for r in temporal.count_drops(frame.where("value IS NOT NULL"), 0.5, length=length).collect()}
    assert whole == cut
    for hours in (3, 30):
        late = {r.device_id: r.drops for r in temporal.trailing_drops(frame, ["device_id"], "value", f"{hours}h", 0.5, length=length).collect()}
        for device in ("busy", "quiet", "lone"):
            own = sorted((t, v) for d, t, v in rows if d == device and v is not None)
            own = [v for t, v in own if t > own[-1][0] - hours * partials.HOUR]
            assert late[device] == sum(b - a < -0.5 for a, b in zip(own, own[1:]))


def test_states_of_batches_merge(spark):
    rows, frame = odd_series(spark)
    whole = partials.states(frame, ["device_id"], ["value"]).select("device_id", "chunk", "value.*")
    part = F.pmod(F.xxhash64("ts", "value"), F.lit(3)) == 0
    both = partials.states(frame.where(part), ["device_id"], ["value"]).union(partials.states(frame.where(~part), ["device_id"], ["value"]))
    merged = partials.added_up(both, ["device_id", "chunk"], "value").select("device_id", "chunk", "value.*")
    want = {(r.device_id, r.chunk): r.asDict() for r in whole.collect()}
    got = {(r.device_id, r.chunk): r.asDict() for r in merged.collect()}
    assert want.keys() == got.keys()
    for key, state in want.items():
        for name, value in state.items():
            if isinstance(value, float):
                scale = 1e-6 if name in ("m2", "tt", "tv") else 1e-12
                assert np.isclose(value, got[key][name], rtol=scale, atol=1e-7), (key, name)
            else:
                assert value == got[key][name] or (name in ("rows", "n", "below") and (value or 0) == (got[key][name] or 0))
