"""Distribution functions, isotonic calibration and temperatures by fold against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import laws
from tidemark.operators import calibration, frame, relations, stats


def test_student_tails_for_few_degrees_of_freedom(spark):
    cases = [(t, n) for n in range(1, 30) for t in (0.0, 0.3, 1.0, 2.5, 9.0)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t double, n int")
    got = {r.i: r.p for r in df.select("i", laws.t_tail(F.col("t"), F.col("n")).alias("p")).collect()}
    for i, (t, n) in enumerate(cases):
        # x = sqrt(n) tan(u) turns the density into a power of the cosine on a finite range
        u = np.linspace(0, math.atan(t / math.sqrt(n)), 20_001)
        f = np.cos(u) ** (n - 1)
        inside = np.trapezoid(f, u) * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
        assert abs(got[i] - (1 - 2 * inside)) < 1e-7, (t, n)


def test_binomial_tails_from_few_to_very_many_throws(spark):
    cases = [(10, 7), (10, 10), (10, 0), (10, 11), (99, 50), (1000, 540), (100_000, 50_400), (4_000_000, 2_002_000)]
    df = spark.createDataFrame(cases, "n long, k long")
    got = {(r.n, r.k): r.p for r in df.select("n", "k", laws.binomial_tail(F.col("n"), F.col("k")).alias("p")).collect()}
    for n, k in cases:
        c = np.arange(max(k, 0), n + 1, dtype=float)
        if n <= 100_000:
            want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) - n * math.log(2)) for x in c)
            assert math.isclose(got[n, k], want, rel_tol=1e-8, abs_tol=1e-300)
        else:
            assert math.isclose(got[n, k], math.erfc((k - 0.5 - n / 2) / math.sqrt(n / 2)) / 2, rel_tol=1e-3)


def test_sign_test_of_a_large_group_makes_no_long_array(spark):
    df = spark.range(2_000_000).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 2 == 1).alias("b"), F.lit(1).alias("g"))
    assert abs(relations.sign_test(df, "a", "b", "g").first().p - 1.0) < 1e-3


def test_correlation_of_three_pairs_and_critical_values(spark):
    df = spark.createDataFrame([(0.5, 3), (0.5, 2), (0.9, 31), (1.0, 9)], "r double, n long")
    p = [r.p for r in df.select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert abs(p[0] - 2 / 3) < 1e-9 and p[1] is None and 0 < p[2] < 1e-9 and p[3] is None
    t = [r.t for r in spark.createDataFrame([(30,), (29,), (10,), (1,), (0,)], "d int").select(laws.critical(0.95, F.col("d")).alias("t")).collect()]
    assert np.allclose(t, [1.96, 1.96 * (1 + 1 / 60), 1.96 * (1 + 20 / 60), 1.96 * (1 + 29 / 60), 1.96 * (1 + 29 / 60)])


def test_mean_tests_of_constants_and_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0), ("d", None)], "g string, x double")
    got = {r.g: r for r in stats.mean_tests(df, "x", "g", sigma=2.0).collect()}
    assert got["a"].t is None and got["a"].z == 0.5 and got["b"].t is None and got["d"].n == 0 and got["d"].t_p is None
    assert math.isclose(got["c"].t, 2.0) and abs(got["c"].t_p - (1 - 2 / math.pi * math.atan(2))) < 1e-9


def test_a_line_through_two_points_has_no_interval(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "symbol string, x double, y double")
    got = {r.symbol: r for r in frame.fitted_intervals(df, "y", "x").collect()}
    assert got["a"].slope == 2 and got["a"].slope_lo is None and got["b"].slope is None


def plain_pava(scores, outcomes):
    """Pools of (score, outcome) pairs with distinct scores first averaged: score -> rate."""
    pools = []
    for x in sorted(set(scores)):
        ys = [y for s, y in zip(scores, outcomes) if s == x]
        pools.append([[x], len(ys), sum(ys)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] > pools[-1][2] / pools[-1][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2] + b[2]]
    return {x: s / n for xs, n, s in pools for x in xs}


@pytest.mark.parametrize("fan", [2, 32])
def test_isotonic_on_continuous_scores_equals_plain_pooling(spark, monkeypatch, fan):
    monkeypatch.setattr(calibration, "FAN", fan)
    rng = np.random.default_rng(4)
    p = np.r_[rng.random(700), 0.5 + rng.random(300) / 1000, np.full(40, 0.25)]  # 300 scores within 0.001, and ties
    y = (rng.random(len(p)) < p**2).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))] + [(5000, None, 1), (5001, 0.5, None)], "i int, p double, y int")
    got = {r.i: r.calibrated for r in calibration.isotonic(df, "p", "y").collect()}
    want = plain_pava(p.tolist(), y.tolist())
    assert got.pop(5000) is None and got.pop(5001) is None
    assert all(abs(got[i] - want[x]) < 1e-12 for i, x in enumerate(p.tolist()))
    points, _ = calibration.isotonic_breakpoints(df, "p", "y")
    marks = sorted((r.lo, r.rate) for r in points.collect())
    assert [r for _, r in marks] == sorted(r for _, r in marks) and {r for _, r in marks} == set(want.values())
    unseen = [-1.0, *rng.random(50).tolist(), 2.0, None]
    rates = {r.k: r.calibrated for r in calibration.apply_isotonic(spark.createDataFrame(list(enumerate(unseen)), "k int, q double"), "q", points).collect()}
    for k, x in enumerate(unseen):
        assert rates[k] == (None if x is None else next((r for lo, r in reversed(marks) if lo <= x), marks[0][1]))
    assert calibration.isotonic(df.limit(0), "p", "y").count() == 0


def test_temperature_comes_from_earlier_folds_only(spark):
    rng = np.random.default_rng(6)
    rows = []
    for fold in range(4):
        for _ in range(60 if fold else 30):
            p = rng.dirichlet([1, 1, 1])
            sharp = p ** (1 + fold) / (p ** (1 + fold)).sum()
            rows.append(("a", fold, *map(float, sharp), int(rng.choice([1, 0, -1], p=p))))
    rows += [("one class", f, 0.5, 0.3, 0.2, 1) for f in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, fold int, u double, f double, d double, y int")
    classes = {"u": 1, "f": 0, "d": -1}
    run = lambda df: {(r.g, r.fold): r for r in calibration.temperature_by_fold(df, classes, "y", ["g"]).collect()}
    got = run(df)

    def loss(rows, t):
        z = np.log(np.maximum(np.array([r[2:5] for r in rows]), 1e-15)) / t
        own = np.array([[1, 0, -1].index(r[5]) for r in rows])
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(own)), own]))

    grid = 0.05 * 400 ** (np.arange(481) / 480)
    for fold in range(4):
        before, mine, r = [x for x in rows if x[0] == "a" and x[1] < fold], [x for x in rows if x[0] == "a" and x[1] == fold], got["a", fold]
        assert (r.n_before, r.n) == (len(before), len(mine)) and abs(r.raw_log_loss - loss(mine, 1.0)) < 1e-9
        if len(before) < 50:
            assert r.temperature is None and r.log_loss is None
        else:
            assert math.isclose(r.temperature, min(grid, key=lambda t: loss(before, t)), rel_tol=1e-9)
            assert abs(r.log_loss - loss(mine, r.temperature)) < 1e-9
    assert all(got["one class", f].temperature is None for f in range(3))
    # the fold's own outcomes, and later ones, do not enter its temperature
    turned = run(df.withColumn("y", F.when(F.col("fold") == 3, -F.col("y")).otherwise(F.col("y"))))
    assert turned["a", 3].temperature == got["a", 3].temperature and turned["a", 3].log_loss != got["a", 3].log_loss
