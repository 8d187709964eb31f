"""Queries: the feature frame, its warm-up, and strategies over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import frame as E
from tidemark.operators.blocks import cut
from tidemark.operators.selection import quantiles
from tidemark.operators import windows as W
from tidemark.plans.registry import BY, daily, full, hourly, lag, over, query, read, roll, stored, with_returns
from tidemark.plans.window_queries import SO_FAR


def _s(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 1.0 WHEN {a} < {b} THEN -1.0 WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0.0 END::DOUBLE"


def _osc(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 100 ELSE 100 - 100 / (1 + {a} / {b}) END"


def frame_sql(bars: str) -> str:
    """Common tables that end in ``frame``; MACD by recursion over the row numbers."""
    k = f"row_number() OVER ({BY})"
    return (
        f"f0 AS (SELECT *, {k} AS k, {lag('close')} AS pc, (high + low + close) / 3 AS tp FROM {bars}), "
        "e AS (SELECT symbol, k, close AS fast, close AS slow, 0.0::DOUBLE AS signal FROM f0 WHERE k = 1 UNION ALL SELECT f0.symbol, f0.k, e.fast + (f0.close - e.fast) * 2 / 13, e.slow + (f0.close - e.slow) * 2 / 27, e.signal + (e.fast + (f0.close - e.fast) * 2 / 13 - e.slow - (f0.close - e.slow) * 2 / 27 - e.signal) * 2 / 10 FROM e JOIN f0 ON f0.symbol = e.symbol AND f0.k = e.k + 1), "
        f"f1 AS (SELECT f0.*, fast - slow - signal AS macd_hist, (close - pc) / nullif(pc, 0) AS returns, ln(close / pc) AS log_returns, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, close - {lag('close', 14)} AS momentum_14, {lag('close', 14)} AS base, {lag('tp')} AS tp0 FROM f0 JOIN e USING (symbol, k)), "
        "f1b AS (SELECT * REPLACE (CASE WHEN pc IS NOT NULL THEN gain END AS gain, CASE WHEN pc IS NOT NULL THEN loss END AS loss), CASE WHEN tp0 IS NOT NULL THEN CASE WHEN tp > tp0 THEN tp * volume ELSE 0 END END AS up, CASE WHEN tp0 IS NOT NULL THEN CASE WHEN tp < tp0 THEN tp * volume ELSE 0 END END AS down FROM f1), "
        f"f2 AS (SELECT *, {roll('avg', 'close', 20)} AS rolling_mean_20, {roll('stddev_pop', 'close', 20)} AS rolling_std_20, {roll('avg', 'gain', 14)} AS g, {roll('avg', 'loss', 14)} AS l, {roll('avg', 'tr', 14)} AS atr_14, {roll('max', 'high', 14)} AS hh, {roll('min', 'low', 14)} AS ll, {roll('avg', 'tp', 20)} AS mid, list(tp) {over(20)} AS inside, {roll('sum', 'up', 14)} AS pos, {roll('sum', 'down', 14)} AS neg, sum(tp * volume) {SO_FAR} / nullif(sum(volume) {SO_FAR}, 0) AS vwap, {roll('stddev_pop', 'log_returns', 20)} AS hist_vol_20, {roll('stddev_pop', 'log_returns', 60)} AS hv60, {roll('stddev_pop', 'returns', 10)} / nullif({roll('stddev_pop', 'returns', 30)}, 0) AS vol_ratio, {roll('avg', 'close', 50)} AS m50 FROM f1b), "
        f"f3 AS (SELECT *, list_sum(list_transform(inside, lambda x: abs(x - mid))) / 20 AS dev FROM f2), "
        f"frame AS (SELECT *, momentum_14 / nullif(base, 0) AS rate_of_change_14, {_osc('g', 'l')} AS rsi_14, (close - (rolling_mean_20 - 2 * rolling_std_20)) / nullif(4 * rolling_std_20, 0) AS bb_pct_b, CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END AS stoch_k, CASE WHEN mid IS NULL THEN NULL WHEN dev = 0 THEN 0 ELSE (tp - mid) / (0.015 * dev) END AS cci_20, {_osc('pos', 'neg')} AS mfi_14, {_s('rolling_mean_20', 'm50')} AS trend_state, {_s('hist_vol_20', 'hv60')} AS vol_regime, {_s('momentum_14', '0')} AS momentum_regime FROM f3)"
    )


NAMES = ", ".join(E.FEATURES)
WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in E.FEATURES)


@query("win35_feature_frame", f"WITH RECURSIVE {frame_sql('bars')} SELECT symbol, ts, {NAMES} FROM frame WHERE {WHOLE}", r=" ".join(E.FEATURES), t="ts", digits=5)
def _(spark, d):
    return E.feature_frame(stored(spark, d, "daily"), drop_missing=True)


_CUT = "bars WHERE ts >= '1996-09-01'"


@query("win36_context_warm_up", f"WITH RECURSIVE {frame_sql('bars')} SELECT symbol, ts, {NAMES} FROM frame WHERE {WHOLE} AND ts >= '1996-09-01'", r=" ".join(E.FEATURES), t="ts", digits=5)
def _(spark, d):
    bars = daily(spark, d)
    return E.with_context(bars.where("ts < '1996-09-01'"), bars.where("ts >= '1996-09-01'"), 60)


@query("res33_warm_up_sensitivity", None, r="most")
def _(spark, d):
    bars = daily(spark, d)
    return E.warm_up_sensitivity(bars.where("ts < '1996-09-01'"), bars.where("ts >= '1996-09-01'"))


@query("win39_trend_strength", f"WITH l AS (SELECT symbol, ts, close AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 20), c AS (SELECT symbol, ts, v - {lag('v')} AS d FROM l), m AS (SELECT symbol, ts, d, {lag('d')} AS p, avg(d) OVER (PARTITION BY symbol) AS m FROM c) SELECT symbol, abs(sum((d - m) * (p - m)) / (count(d) - 1) / var_pop(d)) AS strength FROM m GROUP BY 1", r="strength")
def _(spark, d):
    return E.trend_strength(daily(spark, d), "close")


_SIGNAL = f"CASE WHEN close > {roll('avg', 'close', 20)} * 1.01 THEN 1 WHEN close < {roll('avg', 'close', 20)} * 0.99 THEN -1 ELSE 0 END"


@query("win41_round_trips", f"WITH s AS (SELECT symbol, ts, close, {_SIGNAL} AS signal, row_number() OVER ({BY}) - 1 AS idx FROM bars), c AS (SELECT * FROM (SELECT *, {lag('signal')} AS p FROM s) WHERE p IS NULL OR p <> signal), o AS (SELECT symbol, ts, signal, idx AS entry, close AS ec, lead(idx) OVER ({BY}) AS x, lead(close) OVER ({BY}) AS xc FROM c), e AS (SELECT symbol, max(idx) AS li, arg_max(close, idx) AS lc FROM s GROUP BY 1), p AS (SELECT symbol, ts, signal AS side, entry, coalesce(x, li) AS \"exit\", ec * (1 + signal * 0.0015) AS entry_price, coalesce(xc, lc) * (1 - signal * 0.0015) AS exit_price FROM o JOIN e USING (symbol) WHERE signal <> 0) SELECT *, side * (exit_price - entry_price) / entry_price AS ret, \"exit\" - entry AS bars_held FROM p", r="entry_price exit_price ret", t="ts")
def _(spark, d):
    mean = W.sma("close", 20)
    own = daily(spark, d).select("symbol", "ts", "close", F.when(F.col("close") > mean * 1.01, 1).when(F.col("close") < mean * 0.99, -1).otherwise(0).alias("signal"))
    return E.position_trades(own, 0.0015)


@query("win43_volatility_profile", f"WITH v AS (SELECT symbol, ts, {roll('stddev_samp', 'r', 20)} AS v FROM rets) SELECT symbol, arg_max(v, ts) AS realized, arg_max(v, ts) * sqrt(252) AS annualized, avg(v) AS mean, min(v) AS least, max(v) AS most, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1", use="rets", r="realized annualized mean least most")
def _(spark, d):
    return E.volatility_profile(with_returns(daily(spark, d)), "r")


@query("win44_factor_signal", f"WITH o AS (SELECT symbol, ts, close / {lag('close')} - 1 AS y, {lag('volume')} AS x FROM hourly), c AS (SELECT * FROM o WHERE y IS NOT NULL AND x IS NOT NULL), p AS (SELECT symbol, ts, x, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, avg(y) OVER w AS m, max(x) OVER w > min(x) OVER w AS moves FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, a + b * x AS prediction FROM p WHERE n = 60 AND moves) SELECT symbol, ts, prediction, CASE WHEN prediction > 0.1 THEN 1 WHEN prediction < -0.1 THEN -1 ELSE 0 END AS signal FROM g", use="hourly", r="prediction", t="ts", digits=5)
def _(spark, d):
    own = hourly(spark, d).select("symbol", "ts", (F.try_divide("close", W.previous("close")) - 1).alias("y"), W.previous("volume").alias("x"))
    return E.factor_signal(own, "y", ["x"], 60, 0.1)


@query("agg08_return_statistics", f"WITH o AS (SELECT symbol, r, row_number() OVER ({BY}) > count(*) OVER (PARTITION BY symbol) // 2 AS late FROM rets WHERE r IS NOT NULL), m AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s FROM o GROUP BY 1) SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS volatility, avg(((r - m) / s) ** 3) AS skew, avg(((r - m) / s) ** 4) - 3 AS kurtosis, stddev_samp(r) FILTER (WHERE late) / stddev_samp(r) FILTER (WHERE NOT late) - 1 AS volatility_change FROM o JOIN m USING (symbol) GROUP BY 1", use="rets", r="mean volatility skew kurtosis volatility_change")
def _(spark, d):
    return E.return_statistics(with_returns(daily(spark, d)), "r")


@query("agg59_confident_trades", "WITH t AS (SELECT event_type, (event_id % 20) / 10 AS uncertainty, value / 10 - 1 AS ret FROM events), k AS (SELECT *, 1 / (1 + uncertainty) AS c FROM t WHERE 1 / (1 + uncertainty) >= 0.6) SELECT event_type, count(*) AS trades, sum(ret) AS total, sqrt(252) * avg(ret) / stddev_pop(ret) AS sharpe, avg(c) AS mean_confidence, avg(uncertainty) AS mean_uncertainty FROM k GROUP BY 1", use="", r="total sharpe mean_confidence mean_uncertainty")
def _(spark, d):
    own = read(spark, d, "events").select("event_type", ((F.col("event_id") % 20) / 10).alias("uncertainty"), (F.col("value") / 10 - 1).alias("ret"))
    return E.confident_trades(own, "event_type")


_FIT = "f AS (SELECT {by}, count(*) AS n, regr_slope(high, low) AS slope, regr_sxx(high, low) AS xx, sqrt(greatest(regr_syy(high, low) - regr_sxy(high, low) ** 2 / nullif(regr_sxx(high, low), 0), 0) / nullif(count(*) - 2, 0)) AS s, avg(high) AS y, CASE WHEN count(*) >= 32 THEN 1.96 ELSE 1.96 * (1 + (32 - greatest(count(*), 3)) / 30.0 * 0.5) END::DOUBLE AS t FROM bars GROUP BY ALL)"
_INTERVALS = "n, slope, slope - t * s / sqrt(nullif(xx, 0)) AS slope_lo, slope + t * s / sqrt(nullif(xx, 0)) AS slope_hi, y - t * s * sqrt(1 + 1 / n) AS next_lo, y + t * s * sqrt(1 + 1 / n) AS next_hi"


@query("agg60_intervals", f"WITH {_FIT.format(by='symbol')} SELECT symbol, {_INTERVALS} FROM f", r="slope slope_lo slope_hi next_lo next_hi")
def _(spark, d):
    return E.fitted_intervals(daily(spark, d), "high", "low")


@query("agg60_small_groups", f"WITH {_FIT.replace('(high, low)', '(high, volume)').format(by=chr(39) + chr(39) + ' || symbol AS symbol, date_trunc(' + chr(39) + 'month' + chr(39) + ', ts) AS month')} SELECT symbol, month, {_INTERVALS} FROM f WHERE xx > 1e-9", r="slope slope_lo slope_hi next_lo next_hi", t="month", digits=5)
def _(spark, d):
    """One line a month: up to 31 rows, where the critical value grows as rows get fewer."""
    own = daily(spark, d).withColumn("month", F.date_trunc("month", "ts"))
    moving = own.groupBy("symbol", "month").agg(F.regr_sxx("high", "volume").alias("_xx")).where("_xx > 1e-9").drop("_xx")
    return E.fitted_intervals(own.join(moving, ["symbol", "month"]), "high", "volume", by=["symbol", "month"])


@query("agg06_five_numbers", "SELECT symbol, min(close) AS least, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS median, quantile_cont(close, 0.75) AS q3, max(close) AS most, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS iqr FROM bars GROUP BY 1", r="least q1 median q3 most iqr")
def _(spark, d):
    shares = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}
    return quantiles(daily(spark, d), "close", shares).drop("n").withColumn("iqr", F.col("q3") - F.col("q1"))


@query("win02_long_series", f"SELECT symbol, ts, {roll('avg', 'close', 20)} AS mean, {roll('stddev_samp', 'close', 20)} AS sd FROM hourly", use="hourly", r="mean sd", t="ts")
def _(spark, d):
    return W.rolling_statistics(cut(hourly(spark, d), 19, size=64), "close", 20).select("symbol", "ts", "mean", "sd")


@query("win03_rolling_z", f"SELECT symbol, ts, {roll('min', 'close', 30)} AS lo, {roll('max', 'close', 30)} AS hi, CASE WHEN {roll('stddev_samp', 'close', 30)} = 0 THEN 0 ELSE (close - {roll('avg', 'close', 30)}) / {roll('stddev_samp', 'close', 30)} END AS z FROM bars", r="lo hi z", t="ts")
def _(spark, d):
    return W.rolling_statistics(stored(spark, d, "daily"), "close", 30).select("symbol", "ts", "lo", "hi", "z")


@query("win04_rolling_quantile", f"SELECT symbol, ts, {full(f'quantile_cont(close, 0.5) {over(15)}', 'close', 15)} AS median FROM bars", r="median", t="ts")
def _(spark, d):
    return W.rolling_statistics(stored(spark, d, "daily"), "close", 15).select("symbol", "ts", "median")
