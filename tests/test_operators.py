"""Operators on tiny inputs with values worked out by hand, boundaries, and long-series paths against simple ones."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import scalar
from tidemark.operators import asof, bars, folds, labels, lineage, quality, recursive, regress, relations, resample, retrieval, risk, scan, stats, windows
from tidemark.sources import csv as csv_source
from tidemark.sources import tables
from tidemark.streaming import jobs


def day(k, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k, hours=hour)


def series(spark, closes, symbol="s", volume=1.0):
    rows = [(symbol, day(k), c, c + 1.0, c - 1.0, c, volume) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def column(df, name, by="ts"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r[by])]


def test_timeframes():
    assert schema.timeframe_seconds("H1") == 3600 and schema.timeframe_seconds("1mo") == 30 * 86400
    with pytest.raises(ValueError):
        schema.timeframe_seconds("7x")


def test_rolling_mean_needs_a_full_frame(spark):
    own = series(spark, [1.0, 2.0, 3.0, 4.0])
    assert column(own.select("ts", windows.sma("close", 3).alias("m")), "m") == [None, None, 2.0, 3.0]


def test_zero_base_returns(spark):
    got = windows.returns(series(spark, [0.0, 2.0, 3.0]))
    assert column(got, "ret") == [None, 0.0, 0.5] and column(got, "log_ret")[1] == 0.0


@pytest.mark.parametrize("unit", ["day", "week", "month", "year"])
def test_rows_of_a_long_series_are_numbered(spark, unit):
    rng = np.random.default_rng(1)
    own = series(spark, (100 + rng.normal(size=120).cumsum()).tolist())
    assert column(scan.row_index(own, unit=unit), "idx") == list(range(120))


def test_audit_faults_over_block_edges(spark):
    import hashlib

    rows, before = [], None
    for i in [1, 2, 3, 4, 5, 6, 9, 10, 11]:
        digest = hashlib.sha256(f"p{i}".encode()).hexdigest()
        rows.append((i, "bad" if i == 11 else digest, "broken" if i == 5 else before, f"p{i}"))
        before = digest
    log = spark.createDataFrame(rows, "rowid long, entry_hash string, previous_entry string, payload string")
    for block in (2, 4, 65536):
        assert sorted((r.rowid, r.fault) for r in quality.audit_faults(log, block).collect()) == [(5, "link"), (9, "sequence"), (11, "hash")]


def test_wilder_on_a_straight_line(spark):
    got = recursive.wilder(series(spark, [100 + 0.5 * i for i in range(40)]))
    assert column(got, "rsi")[:14] == [None] * 14 and set(column(got, "rsi")[14:]) == {100.0}
    assert np.allclose(column(got, "atr")[13:], 2.0)


def test_kalman_and_path_dependent_follow_a_constant(spark):
    own = series(spark, [50.0] * 30)
    assert np.allclose(column(recursive.kalman(own), "trend"), 50)
    assert all(v is None or v < 51 for v in column(recursive.path_dependent(own), "sar"))


@pytest.mark.parametrize("width", [None, 3600, 86400, 10 * 86400])
def test_as_of_directions_and_ties(spark, width):
    right = series(spark, [1.0, 2.0, 3.0])
    left = spark.createDataFrame([("s", day(1), 1), ("s", day(1, 5), 2), ("s", day(9), 3), ("t", day(1), 4)], "symbol string, ts timestamp, k int")
    back = {r.k: r.asof_close for r in asof.as_of(left, right, ["close"], width=width).collect()}
    ahead = {r.k: r.asof_close for r in asof.as_of(left, right, ["close"], forward=True, width=width).collect()}
    strict = {r.k: r.asof_close for r in asof.as_of(left, right, ["close"], strict=True, width=width).collect()}
    assert back == {1: 2.0, 2: 2.0, 3: 3.0, 4: None} and ahead == {1: 2.0, 2: 3.0, 3: None, 4: None} and strict[1] == 1.0


@pytest.mark.parametrize("width", [3600, 86400, 5 * 86400])
def test_excursions_leave_out_the_start_and_take_the_end(spark, width):
    own = series(spark, [10.0, 30.0, 20.0, 5.0])
    spans = spark.createDataFrame([("a", "s", day(0), day(2)), ("b", "s", day(1), day(3)), ("c", "s", day(3), None)], "span_id string, symbol string, start timestamp, stop timestamp")
    got = {r.span_id: (r.highest, r.lowest) for r in asof.range_extremes(spans, own, width).collect()}
    assert got == {"a": (31.0, 19.0), "b": (21.0, 4.0)}


def test_overlap_of_half_open_intervals(spark):
    spans = spark.createDataFrame([("s", day(0), day(2)), ("s", day(2), day(4)), ("s", day(1), day(3))], "symbol string, start timestamp, stop timestamp")
    row = asof.overlap_counts(spans).first()
    assert (row.pairs, row.concurrency) == (2, 2)


def test_directional_outcomes(spark):
    own = series(spark, [100.0, 90.0])
    events = spark.createDataFrame([("u", "s", day(0), "bullish", 100.0), ("d", "s", day(0), "bearish", 100.0)], "event_id string, symbol string, ts timestamp, direction string, price double")
    got = {r.event_id: r for r in labels.outcomes(events, own, [1]).collect()}
    assert math.isclose(got["u"].ret, -0.1) and math.isclose(got["d"].ret, 0.1) and got["d"].hit and not got["u"].hit
    assert math.isclose(got["u"].mae, -0.11) and math.isclose(got["d"].mfe, 0.11)
    assert all(r.ret is None for r in labels.outcomes(events, own, [5]).collect())


def test_trades_drop_a_leading_sell_and_close_at_the_end(spark):
    acts = [("s", day(k), p, a) for k, (p, a) in enumerate([(1.0, "SELL"), (2.0, "BUY"), (3.0, "BUY"), (4.0, "SELL"), (5.0, "BUY"), (6.0, "HOLD")])]
    got = labels.first_of_runs(spark.createDataFrame(acts, "symbol string, ts timestamp, price double, action string")).collect()
    assert sorted((r.entry, r.exit) for r in got) == [(2.0, 4.0), (5.0, 6.0)]


def test_streaks_and_episodes_at_the_end(spark):
    rows = spark.createDataFrame([("s", day(k), r) for k, r in enumerate([0.1, 0.2, -0.1, 0.3])], "symbol string, ts timestamp, r double")
    assert sorted((r.length, r.is_open) for r in stats.streaks(rows, "r").collect()) == [(1, False), (1, True), (2, False)]
    got = risk.episodes(risk.drawdowns(series(spark, [1.0, 2.0, 1.0, 3.0]), "close")).collect()
    assert sorted((r.depth, r.is_open) for r in got) == [(-0.5, False), (0.0, True)]


def test_multiple_testing(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r.name: r for r in folds.adjust_p_values(p).collect()}
    assert math.isclose(got["a"].holm, 0.03) and math.isclose(got["c"].holm, 0.06) and math.isclose(got["b"].holm, 0.06)
    assert math.isclose(got["b"].benjamini_hochberg, 0.04) and math.isclose(got["b"].bonferroni, 0.12)


def test_purged_folds_leave_a_gap(spark):
    own = spark.range(100).selectExpr("id as idx", "'a' as symbol").unionByName(spark.range(40).selectExpr("id as idx", "'b' as symbol"))
    rows = folds.assign_purged(own, folds.purged_folds(own, 4, 3, 2)).where("fold = 1").collect()
    part = lambda s, role: {r.idx for r in rows if r.symbol == s and r.role == role}
    assert part("a", "test") == set(range(25, 50)) and part("a", "train") == set(range(22)) | set(range(55, 100))
    assert part("b", "test") == set(range(10, 20)) and part("b", "train") == set(range(7)) | set(range(25, 40))


def test_prior_rate_never_sees_later_outcomes(spark):
    events = spark.createDataFrame([(day(0), day(1), "up", True), (day(1), day(9), "up", False), (day(5), day(6), "up", True)], "ts timestamp, realized_end timestamp, direction string, hit boolean")
    fold = spark.createDataFrame([(0, day(4), day(8))], "fold int, start timestamp, stop timestamp")
    row = folds.prior_rate(events, fold).first()
    assert (row.n_train, row.p, row.n_test) == (1, 1.0, 1)


def test_resampling_agrees_with_theory(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(rng.normal(0.5, 1, 400))], "g string, i long, x double")
    row = resample.bootstrap(df, "x", "i", "g", 300, 1).first()
    assert 0.15 < row.hi - row.lo < 0.25 and row.lo < 0.5 < row.hi
    assert resample.sign_flip_p(df, "x", "i", "g", 200, 1).first().p < 0.01


def test_regressions(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=200) + 1e6, rng.normal(size=200)
    y = 2 * a - 3 * b + 1 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([("s", day(i), *map(float, v)) for i, v in enumerate(zip(y, a, b))], "symbol string, ts timestamp, y double, a double, b double")
    fit = regress.least_squares(df, "y", ["a", "b"]).first()
    assert np.allclose(fit.beta[1:], [2, -3], atol=0.05) and fit.r2 > 0.99
    walk = series(spark, rng.normal(size=300).cumsum().tolist())
    noise = series(spark, rng.normal(size=300).tolist())
    assert regress.adf(noise, "close", 1).first().statistic < -8 < regress.adf(walk, "close", 1).first().statistic
    assert regress.granger(df, "a", "b", 1).first().f >= 0


def test_sign_test_p_value(spark):
    df = spark.createDataFrame([("g", i < 8, i >= 8) for i in range(10)], "g string, a boolean, b boolean")
    assert math.isclose(relations.sign_test(df, "a", "b", "g").first().p, 2 * (1 + 10 + 45) / 1024)


def test_gaps_duplicates_and_rules(spark):
    own = series(spark, [1.0, 2.0, 3.0]).where(F.col("ts") != F.lit(day(1)))
    assert quality.gaps(own, 86400, 1.0).first().missing == 1 and quality.gaps(own, 86400).count() == 0
    assert column(quality.missing_bars(own, 86400), "ts") == [day(1)]
    bad = spark.createDataFrame([("s", day(0), 5.0, 4.0, 1.0, 2.0, 1.0)], own.schema)
    assert quality.validation_report(bad, 86400).first().invalid == 1


def test_digest_does_not_depend_on_order(spark):
    own = series(spark, [1.0, 2.0, 3.0])
    a = tables.catalog(own).first().digest
    assert a == tables.catalog(own.orderBy(F.desc("ts"))).first().digest != tables.catalog(own.where("close > 1")).first().digest
    assert tables.verify(tables.catalog(own), own).count() == 0


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "parent string, child string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in lineage.closure(edges, start).collect()} == {("b", 1), ("c", 2), ("d", 1)}
    assert lineage.shortest_path(edges, "d", "c") == ["d", "a", "c"] and lineage.shortest_path(edges, "d", "zz") == []


def test_deep_graphs_are_walked_to_their_ends(spark):
    chain = spark.range(1000).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    start = spark.createDataFrame([("n0",), ("n990",)], "node string")
    got = lineage.closure(chain, start)
    assert got.count() == 1010 and got.where("depth = cast(substring(node, 2) as long) - cast(substring(start, 2) as long)").count() == 1010
    assert lineage.closure(chain, spark.createDataFrame([("n70",)], "node string"), up=True).count() == 70
    assert lineage.shortest_path(chain.where("parent < 'n2'"), "n19", "n10") == [f"n{i}" for i in range(19, 9, -1)]


def test_closure_of_hubs_and_loops_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(40, 0), (3, 3)] + [(7, k) for k in range(100, 130)] + [(k, 41) for k in range(100, 130)] + [(41 + i, 42 + i) for i in range(20)] + [(rng.randrange(62), rng.randrange(62)) for _ in range(6)]
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want, depth, edge = {5: 0}, 0, {5}
    while edge:
        depth += 1
        edge = {b for a in edge for b in out.get(a, ())} - set(want)
        want |= dict.fromkeys(edge, depth)
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "parent string, child string")
    got = {int(r.node): r.depth for r in lineage.closure(edges, spark.createDataFrame([("5",)], "node string")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_book_metrics(spark):
    level = lambda *x: [{"price": p, "size": s, "order_count": 1} for p, s in x]
    books = spark.createDataFrame([("s", day(0), level((9.0, 1.0), (8.0, 2.0)), level((11.0, 4.0)))], schema.BOOKS)
    row = bars.book_metrics(books).first()
    assert (row.best_bid, row.best_ask, row.mid, row.spread, row.bid_depth, row.ask_depth) == (9.0, 11.0, 10.0, 2.0, 3.0, 4.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("Strong gains, record GAINS; fear!",), ("",)], "t string")
    assert np.allclose([r[0] for r in df.select(scalar.sentiment(F.col("t"))).collect()], [1 / 3, 0.0])
    assert scalar.parse_cost("") == ("fixed", 0.0) and scalar.parse_cost(None, 2.0) == ("fixed", 2.0) and scalar.parse_cost("1.5") == ("fixed", 1.5) and scalar.parse_cost(" PCT:0.1") == ("pct", 0.1)
    for bad in ("half", "share:1", "pct:"):
        with pytest.raises(ValueError):
            scalar.cost(bad, F.col("t"))
    assert schema.timeframe_seconds(" 1Week ") == 604800 and schema.timeframe_seconds("minute") == 60


def test_load_gate(spark, tmp_path):
    (tmp_path / "m.csv").write_text("DATE,V\n2024-01-01,1\n2024-01-01,2\n")
    with pytest.raises(ValueError):
        csv_source.load_macro(spark, f"file://{tmp_path}/m.csv", "V")
    with pytest.raises(ValueError):
        csv_source.epoch_unit(spark.createDataFrame([(5.0,)], "t double"), "t")
    assert csv_source.epoch_unit(spark.createDataFrame([(1.7e12,)], "t double"), "t") == "ms"


def test_thinned_breaks(spark):
    df = spark.createDataFrame([("s", 1, 0.2), ("s", 5, 0.9), ("s", 20, 0.1)], "symbol string, idx long, confidence double")
    assert sorted(r.idx for r in retrieval.thin_breaks(df, 10).collect()) == [5, 20]


def test_bounded_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, "abc"[i % 3], day(0, i), float(i)) for i in range(48)], "user_id int, event_type string, ts timestamp, value double")
    events.repartition(4).write.parquet(f"{tmp_path}/e")
    got = jobs.drain(jobs.windows(jobs.stream_table(spark, f"{tmp_path}/e"), "6 hours"), "complete")
    assert sorted(got.collect()) == sorted(jobs.windows(events, "6 hours").collect())
