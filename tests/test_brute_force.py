"""Queries that SQL does not express, against plain loops over small series."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import extension, frame, recursive, relations, resample, retrieval, stats, trees, walk
from tidemark.streaming import jobs


def bars_of(spark, n=120, seed=3, symbols=("a", "b")):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(size=n))
        for i, c in enumerate(close):
            o, w = c + rng.normal() / 2, abs(rng.normal()) + 0.1
            rows.append((s, datetime(2020, 1, 1) + timedelta(days=i), float(o), float(max(o, c) + w), float(min(o, c) - w), float(c), float(rng.integers(1, 50))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"), rows


def test_supertrend_and_parabolic_stop(spark):
    df, rows = bars_of(spark)
    got = {(r.symbol, r.ts): r for r in recursive.path_dependent(df).collect()}
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        tr = [max(r[3] - r[4], abs(r[3] - p[5]), abs(r[4] - p[5])) for p, r in zip([own[0], *own], own)]
        top = bottom = side = None
        for i, r in enumerate(own):
            if i < 9:
                assert got[s, r[1]].supertrend is None
                continue
            atr, mid, before = sum(tr[i - 9 : i + 1]) / 10, (r[3] + r[4]) / 2, own[i - 1][5]
            new_top, new_bottom = mid + 3 * atr, mid - 3 * atr
            if top is None:
                top, bottom, side = new_top, new_bottom, "up"
            else:
                top = new_top if new_top < top or before > top else top
                bottom = new_bottom if new_bottom > bottom or before < bottom else bottom
            side = ("up" if r[5] >= bottom else "down") if side == "up" else ("up" if r[5] > top else "down")
            assert math.isclose(got[s, r[1]].supertrend, bottom if side == "up" else top, rel_tol=1e-9)
        for a, b in itertools.pairwise(own):
            x, y = got[s, a[1]].sar, got[s, b[1]].sar
            below = lambda stop, r: stop <= r[5]
            if below(x, a) and below(y, b):
                assert x <= y or y <= min(a[4], b[4])  # a rising stop only falls back to the lows before it
            assert min(r[4] for r in own) <= y <= max(r[3] for r in own)


def test_change_points_by_default_and_given_threshold(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=60), rng.normal(size=60) + 6]
    df = spark.createDataFrame([("a", datetime(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp, v double")
    for limit in (None, 5.0):
        got = [(r.ts, r.level) for r in sorted(recursive.change_points(df, "v", limit).collect())]
        h, up, down, want = limit or 4 * x.std(), 0.0, 0.0, []
        for i, v in enumerate(x):
            up, down = max(0, up + v - x.mean() - h / 2), max(0, down - v + x.mean() - h / 2)
            if up > h:
                want.append((datetime(2020, 1, 1) + timedelta(days=i), up))
                up = 0.0
            elif down > h:
                want.append((datetime(2020, 1, 1) + timedelta(days=i), -down))
                down = 0.0
        assert [t for t, _ in got] == [t for t, _ in want] and np.allclose([v for _, v in got], [v for _, v in want])


def test_correlation_p_values(spark):
    cases = [(0.3, 50), (-0.7, 40), (0.01, 1000), (0.99, 100), (1.0, 50), (0.5, 20), (None, 50)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(cases)], "i int, r double, n long")
    got = {x.i: x.p for x in df.select("i", stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()}
    for i, (r, n) in enumerate(cases):
        if r is None or abs(r) == 1:
            assert got[i] is None
        elif n >= 32:
            t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
            assert abs(got[i] - math.erfc(t / math.sqrt(2))) < 1e-9


def test_fold_gate_counts_every_sign(spark):
    d = [0.1, 0.2, -0.05, 0.3, 0.15, 0.25, 0.12, 0.2]
    got = walk.fold_gate(spark.createDataFrame([(0.5 + x, 0.5) for x in d], "baseline double, model double")).first()
    flips = [np.mean([s * x for s, x in zip(signs, d)]) for signs in itertools.product([1, -1], repeat=8)]
    assert (got.positive, got.negative) == (7, 1) and abs(got.sign_p - 2 * 9 / 256) < 1e-12
    assert abs(got.flip_p - np.mean([f >= np.mean(d) - 1e-15 for f in flips])) < 1e-12 and got.ci_lo < np.mean(d) < got.ci_hi and not got.passed


def test_label_shuffle_keeps_labels_and_moves_them(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("label"))
    got = walk.shuffled_labels(df, "label", "k", 5).collect()
    assert sorted(r.k for r in got) == list(range(2000)) and sorted(r.shuffled for r in got) == sorted(r.label for r in got)
    assert 0.25 < np.mean([r.label == r.shuffled for r in got]) < 0.42
    assert got != walk.shuffled_labels(df, "label", "k", 6).collect()


def test_warm_up_sensitivity_is_zero_once_windows_are_full(spark):
    df, _ = bars_of(spark, 300, symbols=("a",))
    cut = "2020-05-01"
    got = frame.warm_up_sensitivity(df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)).collect()
    assert {r.feature for r in got} == set(frame.FEATURES)
    for r in got:
        if r.feature not in ("macd_hist", "vwap") and r.age >= 4:
            assert r.missing == 0 and r.most < 1e-9
        if r.feature == "rolling_mean_20" and r.age == 0:
            assert r.missing == 19
    with pytest.raises(ValueError):
        frame.with_context(df.where(F.col("ts") < cut), df, 60)


def test_bootstrap_of_means_and_medians_agree_with_theory(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(i, float(v), "g") for i, v in enumerate(x)], "k long, v double, g string")
    mean = resample.bootstrap(df, "v", "k", "g", 400, 3).first()
    assert abs((mean.hi - mean.lo) / 2 - 1.96 * x.std() / 20) < 0.05 and mean.lo < x.mean() < mean.hi
    weighted = extension.bootstrap_statistic(df, "v", "k", "g", lambda v, w: float((v * w).sum() / w.sum()), 400).first()
    assert weighted.replicates == 400 and abs((weighted.hi - weighted.lo) - (mean.hi - mean.lo)) < 0.06 and weighted.lo < x.mean() < weighted.hi
    p = resample.sign_flip_p(df.withColumn("v", F.col("v") - float(x.mean())), "v", "k", "g", 200, 3).first().p
    assert p > 0.9 and resample.sign_flip_p(df, "v", "k", "g", 200, 3).first().p < 0.01


def test_retrieval_with_tags_age_and_sources(spark):
    docs = [(1, "alpha beta gamma", "market_memory", ["x"], 0.0), (2, "alpha", "evidence_graph", [], 400.0), (3, "beta beta", "other", ["x", "y"], 36.5), (4, None, "evidence_graph", [], None), (5, "delta 42", "evidence_graph", None, -1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tags array<string>, age_days double")
    queries = spark.createDataFrame([(1, "Alpha BETA", ["x"]), (2, "nothing here", []), (3, "", [])], "query_id long, text string, tags array<string>")
    got = {(r.query_id, r.doc_id): (r.rank, r.score, r.hits) for r in retrieval.token_overlap(df, queries, 3).collect()}
    assert got == {(1, 1): (1, 0.92, 2), (1, 2): (2, 0.5, 1), (1, 3): (3, 0.32, 1)}
    with pytest.raises(ValueError):
        retrieval.token_overlap(df, queries, 3, most_queries=2)


def test_best_settings_of_a_sweep(spark):
    df, rows = bars_of(spark, 200)
    got = [(r.setting, r.trades, r.mean) for r in retrieval.sweep(df, [(3, 8), (5, 20)], 1, 2, 0.001).collect()]
    want = []
    for fast, slow in [(3, 8), (5, 20)]:
        gains = []
        for s in "ab":
            c = [r[5] for r in rows if r[0] == s]
            gap = [None if i < slow - 1 else sum(c[i - fast + 1 : i + 1]) / fast - sum(c[i - slow + 1 : i + 1]) / slow for i in range(len(c))]
            entry = last = None
            for i, (a, b) in enumerate(itertools.pairwise(gap), 1):
                if a is not None and a <= 0 < b and entry is None:
                    entry = c[i]
                elif a is not None and a >= 0 > b and entry is not None:
                    gains.append((c[i] * 0.999 - entry) / entry)
                    entry = None
                if a is not None and (a <= 0 < b or a >= 0 > b):
                    last = c[i]
            if entry is not None:
                gains.append((last * 0.999 - entry) / entry)
        want.append((f"{fast}/{slow}", len(gains), float(np.mean(gains))))
    want.sort(key=lambda w: -w[2])
    assert [w[:2] for w in want] == [g[:2] for g in got] and np.allclose([w[2] for w in want], [g[2] for g in got])


def test_classifier_and_importance_find_the_real_feature(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x, noise = rng.normal(), rng.normal()
        rows.append((i // 200, "train" if i % 200 < 140 else "validation", i, float(x), float(noise), 1 if x > 0.4 else -1 if x < -0.4 else 0))
    parts = spark.createDataFrame(rows, "fold long, role string, k long, x double, noise double, y int")
    classes = sorted({r.y for r in parts.select("y").distinct().collect()})
    assert all(r.n == 60 and r.accuracy > 0.85 > r.baseline for r in trees.classifier(parts, ["x", "noise"], "y", classes, ["fold"]).collect())
    drop = {r.feature: r["drop"] for r in trees.importance(parts, ["x", "noise"], "y", classes, ["fold"], "k", 1).collect()}
    assert drop["x"] > 0.3 > 0.1 > abs(drop["noise"])
    again = {r.feature: r["drop"] for r in trees.importance(parts.repartition(5), ["x", "noise"], "y", classes, ["fold"], "k", 1).collect()}
    assert again == drop


def test_tree_splits_are_the_best_of_all_bins(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(a), float(b), int(rng.random() < (0.9 if (a > 0.6) == (g == "p") else 0.2))) for g in "pq" for a, b in rng.random((150, 2))] + [("p", None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    forest = trees.grow(df, ["a", "b"], "y", [0, 1], ["g"], depth=1, bins=8)
    got = {r.g: (r._feature, r._cut) for r in forest.levels[0].collect()}
    for g in "pq":
        own = [r for r in rows if r[0] == g]
        best = []
        for f in (0, 1):
            v = np.array([np.nan if r[1 + f] is None else r[1 + f] for r in own], float)
            lo, hi = np.nanmin(v), np.nanmax(v)
            place = np.where(np.isnan(v), -1, np.minimum(7, np.floor((v - lo) / (hi - lo) * 8)))
            y = np.array([r[3] for r in own])
            rest = lambda m: m.sum() - ((y[m] == 0).sum() ** 2 + (y[m] == 1).sum() ** 2) / max(m.sum(), 1)
            for cut in sorted(set(place)):
                left = place <= cut
                if left.sum() >= 5 and (~left).sum() >= 5:
                    best.append((rest(np.ones(len(y), bool)) - rest(left) - rest(~left), -f, -cut))
        top = max(best)
        assert got[g] == (-top[1], -top[2])



def test_flat_windows_have_no_correlation_and_zero_forecasts_no_surprise(spark):
    from tidemark.operators.windows import corr, rolling_relation

    rows = [("a", datetime(2020, 1, 1) + timedelta(days=i), 1.0 if i < 6 else float(i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y double")
    got = [r["corr"] for r in sorted(rolling_relation(df, "x", "y", 4).collect())]
    assert got[:6] == [None] * 6 and all(v is not None for v in got[6:])
    assert df.where("ts < '2020-01-05'").agg(corr("x", "y").alias("r")).first().r is None
    s = spark.createDataFrame([("a", 5.0, 0.0), ("a", 3.0, 2.0), ("a", None, 0.0)], "symbol string, actual double, forecast double")
    r = relations.surprises(s, "symbol").first()
    assert (r.n, r["mean"], r.above) == (2, 0.25, 1)


def test_count_windows_of_a_stream_skip_rows_between_steps(spark, tmp_path):
    rows = [("a", datetime(2020, 1, 1) + timedelta(minutes=i), i, float(i)) for i in range(23)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, value double").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("symbol string, ts timestamp, seq long, value double").parquet(f"{tmp_path}/t")
    got = sorted((r.start, r.mean) for r in jobs.drain(jobs.count_windows(stream, 4, 7), "append").collect())
    assert got == [(s, s + 1.5) for s in (0, 7, 14)]
