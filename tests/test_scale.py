"""Selection, digests and replicates: equal to plain computation, and bounded whatever the size of a group."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, quality, resample, risk, selection


@pytest.mark.parametrize("few", [3, 4096])
def test_selected_elements_are_those_of_the_sorted_values(spark, few):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=900), "tied": np.repeat([1.0, 2.0, 2.5], 300), "one": np.array([4.0]), "far": np.r_[rng.random(500), 1e18, -1e18], "close": 1 + np.arange(200) * 1e-15}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("normal", float("nan")), ("normal", None), ("normal", float("inf"))]
    df = spark.createDataFrame(rows, "symbol string, x double")
    got = {r.symbol: r for r in selection.elements(df, "x", {"a": F.floor(F.col("n") / 4), "b": F.col("n") - 1, "c": F.lit(0), "d": F.lit(100_000)}, few=few).collect()}
    for g, x in groups.items():
        s = np.sort(x)
        assert (got[g].n, got[g].a, got[g].b, got[g].c, got[g].d) == (len(s), s[len(s) // 4], s[-1], s[0], None)
    q = {r.symbol: r for r in selection.quantiles(df, "x", {"m": 0.5, "t": 0.9}).collect()}
    for g, x in groups.items():
        assert math.isclose(q[g].m, np.quantile(x, 0.5), rel_tol=1e-12, abs_tol=1e-12) and math.isclose(q[g].t, np.quantile(x, 0.9), rel_tol=1e-12, abs_tol=1e-12)
    assert selection.elements(df.limit(0), "x", {"a": F.lit(0)}).count() == 0


def test_tail_risk_with_ties(spark):
    x = [-3.0, -2.0, -2.0, -2.0, *[0.1] * 36]
    df = spark.createDataFrame([("a", v) for v in x], "symbol string, r double")
    row = risk.tail_risk(df, "r").first()
    assert row.var == 2.0 and math.isclose(row.expected_shortfall, (3 + 2 + 2) / 3)


def test_digest_does_not_depend_on_order_and_sees_every_change(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "a").when(F.col("id") < 2990, "b").alias("k"), (F.col("id") % 1000).alias("x"), F.lit("v").alias("y"))
    digests = lambda rows, leaf: {r.k: (r.digest, r.n) for r in quality.dataset_digest(rows, ["x", "y"], "k", leaf).collect()}
    for leaf in (4, 64, 1024):
        one = digests(df, leaf)
        assert digests(df.repartition(7).orderBy(F.desc("x")), leaf) == one and {k: n for k, (_, n) in one.items()} == {"a": 2900, "b": 90, None: 10}
        changed = digests(df.withColumn("y", F.when((F.col("x") == 5) & (F.col("k") == "a"), "w").otherwise(F.col("y"))), leaf)
        assert changed["a"] != one["a"] and changed["b"] == one["b"]
        assert digests(df.unionByName(df.where("k = 'b' and x = 900")), leaf)["b"] != one["b"]


def test_replicates_equal_a_direct_computation_at_every_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(0.1, 1, 600))]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    keys = {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}
    one = {r.g: r for r in resample.bootstrap(df, "x", "i", "g", 50, 3, statistic="sharpe").collect()}
    other = {r.g: r for r in resample.bootstrap(df.repartition(5, "x"), "x", "i", "g", 50, 3, statistic="sharpe").collect()}
    for g in "ab":
        own = [(keys[i], v) for i, k, v in rows if k == g]
        w = resample.poisson_weights(np.array([h for h, _ in own], np.int64).view(np.uint64), 50, 3)
        v = np.array([v for _, v in own])
        m = (w * v[:, None]).sum(0) / w.sum(0)
        s = math.sqrt(252) * m / np.sqrt((w * v[:, None] ** 2).sum(0) / w.sum(0) - m**2)
        assert np.allclose([one[g].lo, one[g].hi, one[g].mean], [np.quantile(s, 0.025), np.quantile(s, 0.975), s.mean()])
        assert np.allclose([one[g].lo, one[g].hi], [other[g].lo, other[g].hi])
    w = resample.poisson_weights(np.arange(20_000, dtype=np.uint64), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_flat_returns_have_a_sharpe_of_zero_and_empty_tables_no_rows(spark):
    flat = spark.createDataFrame([(i, "a", 0.5) for i in range(30)], "i int, g string, x double")
    row = resample.bootstrap(flat, "x", "i", "g", 20, statistic="sharpe").first()
    assert (row.lo, row.hi) == (0.0, 0.0)
    assert resample.bootstrap(flat.limit(0), "x", "i", "g").count() == 0 and resample.sign_flip_p(flat.limit(0), "x", "i", "g").count() == 0


def test_shuffled_rows_do_not_grow_with_the_replicates(spark):
    df = spark.range(20_000).select("id", F.lit("a").alias("g"), F.rand(1).alias("x"))
    plan = resample.bootstrap(df, "x", "id", "g", 100)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in text and text.index("MapInPandas") > text.index("Generate")  # vectors are taken apart after the task


def test_folds_of_every_series(spark):
    rows = [(s, datetime(2020, 1, 1) + timedelta(days=i)) for s, n in (("a", 100), ("b", 50), ("c", 71)) for i in range(n)]
    got = folds.expanding_folds_of(spark.createDataFrame(rows, "symbol string, ts timestamp"), 50, 20).collect()
    assert sorted((r.symbol, r.fold, r.test_lo, r.test_hi) for r in got) == [("a", 0, 50, 70), ("a", 1, 70, 90), ("a", 2, 90, 100), ("c", 0, 50, 70), ("c", 1, 70, 71)]
