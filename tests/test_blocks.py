"""Measures over blocks of a series give what they give over the whole series."""

import functools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, frame, labels, quality, recursive, windows
from tidemark.sources import series


def bars(spark, n=150, symbols=("a",), seed=3):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(size=n) + np.sin(np.arange(n) / 9) / 2)
        for i, c in enumerate(close):
            o, w = c + rng.normal() / 2, abs(rng.normal()) + 0.1
            rows.append((s, datetime(2020, 1, 1) + timedelta(days=i + 3 * (i // 40)), float(o), float(max(o, c) + w), float(min(o, c) - w), float(c), float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def rows_of(df):
    """Rows in order of series and time, doubles to six decimals."""
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    names = [c for c in ("symbol", "ts") if c in df.columns] + sorted(set(df.columns) - {"symbol", "ts"})
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


MEASURES = {
    "returns": windows.returns,
    "rolling_statistics": lambda b: windows.rolling_statistics(b, "close", 7),
    "return_volatility": lambda b: windows.return_volatility(b, 9),
    "expanding": lambda b: windows.expanding(b, "close"),
    "bands": lambda b: windows.bands(b, 12),
    "wma": lambda b: windows.wma(b, "close", 6, "w"),
    "hma": lambda b: windows.hma(b, "close", 16, "h"),
    "volume_flow": lambda b: windows.volume_flow(b, 9),
    "rolling_mfi": lambda b: windows.rolling_mfi(b, 9),
    "momentum": lambda b: windows.momentum(b, 10, 20),
    "cci": lambda b: windows.cci(b, 11),
    "stochastic": lambda b: windows.stochastic(b),
    "simple_oscillators": lambda b: windows.simple_oscillators(b, 8),
    "ichimoku": lambda b: windows.ichimoku(b, 4, 8, 14),
    "rolling_relation": lambda b: windows.rolling_relation(b, "close", "volume", 13),
    "volatility_features": lambda b: windows.volatility_features(b, 4, 9, 12),
    "trend_state": lambda b: windows.trend_state(b, 5, 11, 6, 4, 13),
    "crossovers": lambda b: windows.crossovers(b),
    "thresholds": lambda b: windows.thresholds(b, "close", 15),
    "factor_features": lambda b: windows.factor_features(b, "close"),
    "lag_features": lambda b: windows.lag_features(b, [1, 4]),
    "forward_labels": lambda b: labels.forward_labels(b, 5, w=9),
    "triple_barrier": lambda b: labels.triple_barrier(b, 0.01, 0.02, 6),
    "bar_outcomes": lambda b: labels.bar_outcomes(b, 5, 0.001),
    "gaps": lambda b: quality.gaps(b, 86400),
    "missing_bars": lambda b: quality.missing_bars(b, 86400),
    "validation_report": lambda b: quality.validation_report(b, 86400),
    "upper_median_interval": quality.upper_median_interval,
    "feature_frame": frame.feature_frame,
    "ema": lambda b: recursive.ema(b, "close", 9, "e"),
    "ema_mean_seed": lambda b: recursive.ema(b, "close", 40, "e", "mean"),
    "macd": recursive.macd,
    "keltner": recursive.keltner,
    "wilder": recursive.wilder,
    "directional": recursive.directional,
    "kalman": recursive.kalman,
    "path_dependent": recursive.path_dependent,
}


@pytest.mark.parametrize("name", MEASURES)
def test_blocks_equal_the_whole_series(spark, name):
    own = bars(spark)
    whole, parts = (blocks.cut(own, 75, 10, size) for size in (1 << 16, 29))
    assert rows_of(MEASURES[name](parts)) == rows_of(MEASURES[name](whole))


def test_plain_rows_are_cut_and_one_series_runs_in_many_tasks(spark):
    own = bars(spark)
    assert rows_of(windows.bands(own, 12)) == rows_of(windows.bands(blocks.cut(own, 11, 0, 29), 12))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = windows.bands(blocks.cut(own, 11, 0, 10), 12).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_a_measure_that_reads_further_than_the_copies_is_refused(spark):
    with pytest.raises(ValueError):
        windows.bands(blocks.cut(bars(spark), 10, 0, 29), 12)


def test_round_trips_over_blocks(spark, monkeypatch):
    import random

    rng = random.Random(9)
    acts = [(s, datetime(2020, 1, 1) + timedelta(days=i), float(i), rng.choice(["BUY", "BUY", "HOLD", "SELL"])) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(acts, "symbol string, ts timestamp, price double, action string")
    want = []
    for s in "ab":
        entry = None
        for _, ts, price, action in [a for a in acts if a[0] == s]:
            if action == "BUY" and entry is None:
                entry = (ts, price)
            elif action == "SELL" and entry is not None:
                want.append((s, *entry, ts, price))
                entry = None
        if entry is not None:
            last = [a for a in acts if a[0] == s][-1]
            want.append((s, *entry, last[1], last[2]))
    real = blocks.cut
    for size in (1 << 16, 7):
        monkeypatch.setattr(labels, "cut", lambda rows, back, ahead=0, size=size, keep=False: real(rows, back, ahead, size))
        assert sorted(map(tuple, labels.first_of_runs(df).collect())) == sorted(want)


def test_return_volatility_equals_the_rolling_deviation(spark):
    own = bars(spark)
    with_r = own.select("symbol", "ts", windows.simple_return().alias("r"))
    assert rows_of(windows.return_volatility(own, 9)) == rows_of(windows.rolled(with_r, F.stddev_samp, "r", 9))


def test_stacked_measures_share_one_sort(spark):
    cut = blocks.cut(bars(spark, symbols=("a", "b")), 30, 5, 29)
    both = cut.stack(functools.partial(windows.bands, w=12), windows.cci, functools.partial(labels.bar_outcomes, horizon=5, cost=0.0))
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [symbol")
    assert sorts(both) == sorts(windows.returns(cut))  # those of numbering, and one
    single = windows.bands(cut, 12).join(windows.cci(cut), ["symbol", "ts"]).join(labels.bar_outcomes(cut, 5, 0.0), ["symbol", "ts"])
    assert rows_of(both) == rows_of(single.select(both.columns))


def test_missing_and_numeric_symbols_and_empty_tables(spark):
    own = bars(spark, 40).withColumn("symbol", F.when(F.col("ts") < "2020-01-20", F.lit(7)))
    got = windows.returns(own)
    assert dict(got.dtypes)["symbol"] == "int" and {r.symbol for r in got.collect()} == {7, None} and got.where("ret is null").count() == 2
    assert windows.returns(own.limit(0)).count() == 0 and recursive.macd(own.limit(0)).count() == 0 and recursive.path_dependent(own.limit(0)).count() == 0


def test_change_points_over_blocks_equal_the_plain_fold(spark, monkeypatch):
    x = np.r_[np.random.default_rng(1).normal(size=90), np.random.default_rng(2).normal(size=90) + 6]
    df = spark.createDataFrame([("a", datetime(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp, v double")
    h, up, down, want = 5.0, 0.0, 0.0, []
    for v in x:
        up, down = max(0.0, up + v - x.mean() - h / 2), max(0.0, down - v + x.mean() - h / 2)
        if up > h:
            want.append(round(up, 8))
            up = 0.0
        elif down > h:
            want.append(round(-down, 8))
            down = 0.0
    for size in (1 << 16, 17, 2):
        monkeypatch.setattr(recursive, "as_blocks", lambda rows, back, ahead=0, size=size: blocks.cut(rows, back, ahead, size))
        assert [round(r.level, 8) for r in sorted(recursive.change_points(df, "v", h).collect())] == want and want


def test_wilder_directions_equal_a_loop(spark):
    own = bars(spark, 90)
    h, low, c = (np.array([r[k] for r in sorted(own.collect(), key=lambda r: r.ts)]) for k in ("high", "low", "close"))
    p, n = 14, len(c)
    tr = np.r_[h[0] - low[0], np.maximum.reduce([h[1:] - low[1:], abs(h[1:] - c[:-1]), abs(low[1:] - c[:-1])])]
    up, down = np.r_[0, h[1:] - h[:-1]], np.r_[0, low[:-1] - low[1:]]

    def rma(x):
        out = [None] * (p - 1) + [sum(x[:p]) / p]
        for v in x[p:]:
            out.append(v / p + (1 - 1 / p) * out[-1])
        return out

    t, a, b = rma(tr.tolist()), rma(np.where((up > down) & (up > 0), up, 0).tolist()), rma(np.where((down > up) & (down > 0), down, 0).tolist())
    plus, minus = ([100 * x[i] / t[i] for i in range(p - 1, n)] for x in (a, b))
    adx = rma([100 * abs(x - y) / (x + y) for x, y in zip(plus, minus)])
    got = sorted(recursive.directional(blocks.cut(own, 1, 0, 13)).collect(), key=lambda r: r.ts)
    assert np.allclose([r.plus_di for r in got[p - 1 :]], plus) and np.allclose([r.minus_di for r in got[p - 1 :]], minus)
    assert [r.adx for r in got[: 2 * p - 2]] == [None] * (2 * p - 2) and np.allclose([r.adx for r in got[2 * p - 2 :]], adx[p - 1 :])
    assert [r.adxr for r in got[: 3 * p - 2]] == [None] * (3 * p - 2)
    assert np.allclose([r.adxr for r in got[3 * p - 2 :]], [(got[i].adx + got[i - p].adx) / 2 for i in range(3 * p - 2, n)])


def test_series_store_reads_without_exchange_or_sort(spark):
    own = bars(spark, 200, ("a", "b", "c"))
    kept = series.write(own, "bars_of_test", back=60, ahead=5, size=64, buckets=4)
    again = series.read(spark, "bars_of_test")
    assert (again.back, again.ahead, again.size, again.most) == (60, 5, 64, 4) == (kept.back, kept.ahead, kept.size, kept.most)
    assert rows_of(again.rows()) == rows_of(own) and rows_of(windows.returns(again)) == rows_of(windows.returns(own))
    for measure in (windows.returns, functools.partial(windows.bands, w=20)):
        plan = measure(again)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan
    assert rows_of(recursive.macd(again)) == rows_of(recursive.macd(own))
    assert rows_of(recursive.path_dependent(again)) == rows_of(recursive.path_dependent(own))
    series.drop(spark, "bars_of_test")
    with pytest.raises(Exception):
        series.read(spark, "bars_of_test")
