"""Queries: bars, projections, windows, indicators and labels over the daily and hourly series."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import labels as L
from tidemark.operators import recursive as R
from tidemark.operators import scan as S
from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.operators.blocks import cut
from tidemark.plans.registry import BY, daily, full, hourly, lag, over, query, read, roll, stored, ticks, with_returns
from tidemark.sources.scratch import stored as keep

SO_FAR = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("agg01_bars_from_ticks", "SELECT * FROM bars", r="open high low close volume", t="ts")
def _(spark, d):
    return daily(spark, d)


@query("agg01_hourly_bars", "SELECT * FROM hourly", use="hourly", r="open high low close volume", t="ts")
def _(spark, d):
    return hourly(spark, d)


@query(
    "agg02_weekly_bars_vwap",
    "SELECT symbol, to_timestamp(floor(epoch(ts) / 604800) * 604800)::TIMESTAMP AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars, sum((high + low + close) / 3 * volume) / sum(volume) AS vwap FROM bars GROUP BY 1, 2",
    r="open high low close volume vwap",
    t="ts",
)
def _(spark, d):
    return B.resample(daily(spark, d), 604800)


@query(
    "agg03_count_chunks",
    "WITH i AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 20 AS chunk FROM bars) SELECT symbol, chunk::BIGINT AS chunk, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars FROM i GROUP BY symbol, chunk",
    r="open high low close volume",
    t="ts",
)
def _(spark, d):
    return B.count_chunks(daily(spark, d), 20)


@query(
    "agg01_many_timeframes",
    "SELECT symbol, s.seconds::INT AS seconds, to_timestamp(floor(epoch(ts) / s.seconds) * s.seconds)::TIMESTAMP AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM hourly, (VALUES (14400), (86400)) AS s(seconds) GROUP BY 1, 2, 3",
    use="hourly",
    r="open high low close volume",
    t="ts",
)
def _(spark, d):
    return B.resample_many(hourly(spark, d), [14400, 86400])


@query(
    "prj01_derived_columns",
    "SELECT symbol, ts, high - low AS range, abs(close - open) AS body, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, (high + low + close) / 3 AS typical_price, close > open AS is_bullish, CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_position FROM bars",
    r="range body upper_wick lower_wick typical_price close_position",
    t="ts",
)
def _(spark, d):
    return B.derived_columns(daily(spark, d)).drop("open", "high", "low", "close", "volume", "n_ticks")


@query(
    "prj05_book_metrics",
    "WITH b AS (SELECT o_orderpriority AS symbol, date_trunc('month', o_orderdate) AS ts, o_totalprice / 997 AS p, o_orderkey % 2 AS side, o_orderkey FROM orders), g AS (SELECT symbol, ts, max(CASE WHEN side = 0 THEN p - 500 END) AS best_bid, min(CASE WHEN side = 1 THEN p + 500 END) AS best_ask, sum(CASE WHEN side = 0 THEN 1.0 + o_orderkey % 7 ELSE 0 END) AS bid_depth, sum(CASE WHEN side = 1 THEN 1.0 + o_orderkey % 7 ELSE 0 END) AS ask_depth FROM b GROUP BY 1, 2) SELECT symbol, ts, best_bid, best_ask, (best_bid + best_ask) / 2 AS mid, best_ask - best_bid AS spread, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 AS spread_bps, bid_depth::DOUBLE AS bid_depth, ask_depth::DOUBLE AS ask_depth FROM g",
    use="",
    r="best_bid best_ask mid spread spread_bps bid_depth ask_depth",
    t="ts",
)
def _(spark, d):
    o = read(spark, d, "orders")
    level = F.struct((F.col("o_totalprice") / 997 + F.when(F.col("o_orderkey") % 2 == 0, -500).otherwise(500)).alias("price"), (F.lit(1.0) + F.col("o_orderkey") % 7).alias("size"))
    side = lambda k: F.collect_list(F.when(F.col("o_orderkey") % 2 == k, level))
    books = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("ts")).agg(side(0).alias("bids"), side(1).alias("asks"))
    return B.book_metrics(books)


@query(
    "prj06_range_query_per_symbol_limit",
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars WHERE symbol IN ('1-URGENT', '5-LOW') AND ts BETWEEN '1996-01-01' AND '1997-12-31') SELECT symbol, ts, close FROM k WHERE rn <= 50",
    r="close",
    t="ts",
)
def _(spark, d):
    return B.range_query(daily(spark, d), ["1-URGENT", "5-LOW"], "1996-01-01", "1997-12-31", ["symbol", "ts", "close"], limit=50)


@query(
    "prj13_scaling",
    "WITH s AS (SELECT symbol, min(close) lo, max(close) hi, avg(close) mean, stddev_pop(close) sd, quantile_cont(close, 0.25) q1, quantile_cont(close, 0.5) q2, quantile_cont(close, 0.75) q3 FROM bars GROUP BY symbol) SELECT symbol, ts, (close - lo) / (hi - lo) AS min_max, (close - mean) / sd AS z, (close - q2) / (q3 - q1) AS robust FROM bars JOIN s USING (symbol)",
    r="min_max z robust",
    t="ts",
)
def _(spark, d):
    return B.scaled(daily(spark, d).select("symbol", "ts", "close"), "close").drop("close")


@query("win01_returns", f"SELECT symbol, ts, close - {lag('close')} AS change, close / {lag('close')} - 1 AS ret, ln(close / {lag('close')}) AS log_ret FROM bars", r="change ret log_ret", t="ts")
def _(spark, d):
    return W.returns(stored(spark, d, "daily"))


@query(
    "win02_rolling_statistics",
    f"SELECT symbol, ts, {roll('avg', 'close', 20)} AS mean, {roll('stddev_samp', 'close', 20)} AS sd, {roll('stddev_pop', 'close', 20)} AS sd_pop, {roll('min', 'close', 20)} AS lo, {roll('max', 'close', 20)} AS hi, {full(f'(close - avg(close) {over(20)}) / stddev_samp(close) {over(20)}', 'close', 20)} AS z, {full(f'quantile_cont(close, 0.5) {over(20)}', 'close', 20)} AS median FROM bars",
    r="mean sd sd_pop lo hi z median",
    t="ts",
)
def _(spark, d):
    return W.rolling_statistics(stored(spark, d, "daily"), "close", 20)


@query("win05_expanding", f"SELECT symbol, ts, avg(close) {SO_FAR} AS mean, stddev_samp(close) {SO_FAR} AS sd FROM bars", r="mean sd", t="ts")
def _(spark, d):
    return W.expanding(stored(spark, d, "daily"), "close")


@query(
    "win06_stability",
    f"WITH c AS (SELECT symbol, CASE WHEN count(*) {over(60)} = 60 THEN corr(high, low) {over(60)} END AS c FROM bars) SELECT symbol, count(*) AS n, avg(c) AS mean_corr, stddev_pop(c) AS sd_corr, CASE WHEN stddev_pop(c) < 0.1 THEN 'stable' WHEN stddev_pop(c) < 0.2 THEN 'slight' ELSE 'volatile' END AS label FROM c WHERE c IS NOT NULL GROUP BY symbol",
    r="mean_corr sd_corr",
)
def _(spark, d):
    return W.stability(W.rolling_relation(stored(spark, d, "daily"), "high", "low", 60))


@query(
    "win07_bands",
    f"SELECT symbol, ts, {roll('avg', 'close', 20)} AS mid, {full(f'avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}', 'close', 20)} AS upper, {full(f'avg(close) {over(20)} - 2 * stddev_pop(close) {over(20)}', 'close', 20)} AS lower, {roll('max', 'high', 20)} AS channel_hi, {roll('min', 'low', 20)} AS channel_lo FROM bars",
    r="mid upper lower channel_hi channel_lo",
    t="ts",
)
def _(spark, d):
    return W.bands(stored(spark, d, "daily"))


def _wma(of: str, w: int) -> str:
    return "(" + " + ".join(f"{lag(of, k)} * {w - k}" for k in range(w)) + f") / {w * (w + 1) / 2}"


@query("win08_wma_hma", f"WITH a AS (SELECT symbol, ts, {_wma('close', 8)} AS half, {_wma('close', 16)} AS wma FROM bars), b AS (SELECT *, 2 * half - wma AS diff FROM a) SELECT symbol, ts, wma, {_wma('diff', 4)} AS hma FROM b", r="wma hma", t="ts")
def _(spark, d):
    return stored(spark, d, "daily").stack(partial(W.wma, of="close", w=16, out="wma"), partial(W.hma, of="close", w=16, out="hma"))


@query(
    "win09_win10_volume_flow",
    f"WITH o AS (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS mf, close * volume AS cv, (high + low + close) / 3 * volume AS tv, CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END AS sv FROM hourly) SELECT symbol, ts, {roll('sum', 'cv', 20)} / {roll('sum', 'volume', 20)} AS vwma, {roll('sum', 'mf', 20)} / {roll('sum', 'volume', 20)} AS cmf, sum(tv) {SO_FAR} / sum(volume) {SO_FAR} AS vwap, sum(sv) {SO_FAR} AS obv, sum(mf) {SO_FAR} AS ad FROM o",
    use="hourly",
    r="vwma cmf vwap obv ad",
    t="ts",
)
def _(spark, d):
    return W.volume_flow(stored(spark, d, "hourly"))


@query(
    "win09_rolling_mfi",
    f"WITH o AS (SELECT symbol, ts, (high + low + close) / 3 AS tp, volume FROM bars), f AS (SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume WHEN {lag('tp')} IS NOT NULL THEN 0 END AS up, CASE WHEN tp < {lag('tp')} THEN tp * volume WHEN {lag('tp')} IS NOT NULL THEN 0 END AS down FROM o), s AS (SELECT symbol, ts, {roll('sum', 'up', 14)} AS u, {roll('sum', 'down', 14)} AS v FROM f) SELECT symbol, ts, CASE WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END AS mfi FROM s",
    r="mfi",
    t="ts",
)
def _(spark, d):
    return W.rolling_mfi(stored(spark, d, "daily"))


@query("win11_momentum", f"SELECT symbol, ts, (close / {lag('close', 10)} - 1) * 100 AS roc, close - {lag('close', 10)} AS momentum, (close - {roll('avg', 'close', 20)}) / {roll('avg', 'close', 20)} AS distance FROM bars", r="roc momentum distance", t="ts")
def _(spark, d):
    return W.momentum(stored(spark, d, "daily"))


@query(
    "win12_cci",
    f"WITH o AS (SELECT symbol, ts, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, {roll('avg', 'tp', 20)} AS mean, {full(f'list(tp) {over(20)}', 'tp', 20)} AS l FROM o) SELECT symbol, ts, (tp - mean) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - mean)))) AS cci FROM m",
    r="cci",
    t="ts",
)
def _(spark, d):
    return W.cci(stored(spark, d, "daily"))


@query("win13_stochastic", f"WITH o AS (SELECT symbol, ts, 100 * (close - {roll('min', 'low', 14)}) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)}) AS raw FROM bars), k AS (SELECT symbol, ts, {roll('avg', 'raw', 3)} AS k FROM o) SELECT symbol, ts, k, {roll('avg', 'k', 3)} AS d FROM k", r="k d", t="ts")
def _(spark, d):
    return W.stochastic(stored(spark, d, "daily"))


_TR = f"CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"


@query(
    "win14_simple_oscillators",
    f"WITH o AS (SELECT symbol, ts, CASE WHEN {lag('close')} IS NOT NULL THEN greatest(close - {lag('close')}, 0) END AS gain, CASE WHEN {lag('close')} IS NOT NULL THEN greatest({lag('close')} - close, 0) END AS loss, {_TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down FROM bars), p AS (SELECT *, CASE WHEN up IS NULL THEN NULL WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN up IS NULL THEN NULL WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus FROM o), i AS (SELECT symbol, ts, CASE WHEN {roll('avg', 'loss', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {roll('avg', 'gain', 14)} / {roll('avg', 'loss', 14)}) END AS rsi, {roll('avg', 'tr', 14)} AS atr, 100 * {roll('avg', 'plus', 14)} / {roll('avg', 'tr', 14)} AS plus_di, 100 * {roll('avg', 'minus', 14)} / {roll('avg', 'tr', 14)} AS minus_di FROM p), x AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx FROM i) SELECT symbol, ts, rsi, atr, plus_di, minus_di, {roll('avg', 'dx', 14)} AS adx FROM x",
    r="rsi atr plus_di minus_di adx",
    t="ts",
)
def _(spark, d):
    return W.simple_oscillators(stored(spark, d, "daily"))


def _mid(w: int) -> str:
    return f"({roll('max', 'high', w)} + {roll('min', 'low', w)}) / 2"


@query("win15_ichimoku", f"WITH o AS (SELECT symbol, ts, close, {_mid(9)} AS conversion, {_mid(26)} AS base, {_mid(52)} AS slow FROM bars) SELECT symbol, ts, conversion, base, {lag('(conversion + base) / 2', 26)} AS span_a, {lag('slow', 26)} AS span_b, lead(close, 26) OVER ({BY}) AS lagging FROM o", r="conversion base span_a span_b lagging", t="ts")
def _(spark, d):
    return W.ichimoku(stored(spark, d, "daily"))


@query(
    "win20_volatility_features",
    f"WITH a AS (SELECT symbol, ts, ln(close / {lag('close')}) AS r FROM bars), b AS (SELECT symbol, ts, {roll('stddev_samp', 'r', 10)} * sqrt(252) AS vol, {roll('stddev_samp', 'r', 30)} * sqrt(252) AS long_vol FROM a), c AS (SELECT *, {full(f'list(vol) {over(60)}', 'vol', 60)} AS seen FROM b), e AS (SELECT symbol, ts, vol, vol / long_vol AS vol_ratio, len(list_filter(seen, lambda x: x <= vol)) / 60.0 AS vol_rank FROM c) SELECT *, CASE WHEN vol_rank > 0.8 THEN 'high' WHEN vol_rank < 0.2 THEN 'low' WHEN vol_rank IS NOT NULL THEN 'normal' END AS regime FROM e",
    r="vol vol_ratio vol_rank",
    t="ts",
)
def _(spark, d):
    return W.volatility_features(stored(spark, d, "daily"))


CROSS = f"a AS (SELECT symbol, ts, close, {roll('avg', 'close', 5)} AS f, {roll('avg', 'close', 20)} AS s FROM bars), b AS (SELECT *, f - s AS gap, {lag('f - s')} AS before FROM a), ev AS (SELECT symbol || '|' || epoch(ts)::BIGINT AS event_id, symbol, ts, CASE WHEN before <= 0 AND gap > 0 THEN 'bullish' WHEN before >= 0 AND gap < 0 THEN 'bearish' END AS direction, close AS price, f AS sma_fast, s AS sma_slow, isodow(ts) - 1 AS weekday FROM b)"


@query("win27_crossovers", f"WITH {CROSS} SELECT event_id, symbol, ts, direction, price, sma_fast, sma_slow, weekday::INT AS weekday FROM ev WHERE direction IS NOT NULL", r="price sma_fast sma_slow", t="ts")
def _(spark, d):
    return W.crossovers(stored(spark, d, "daily"))


@query("win33_lag_features", f"SELECT symbol, ts, {', '.join(f'{lag('r', k)} AS r_lag{k}' for k in (1, 2, 5))}, r * {lag('r')} AS r_x_lag1, r * volume AS r_x_volume FROM rets", use="rets", r="r_lag1 r_lag2 r_lag5 r_x_lag1 r_x_volume", t="ts")
def _(spark, d):
    return W.lag_features(stored(spark, d, "daily"), [1, 2, 5])


@query("win34_factor_features", f"SELECT symbol, ts, close / {lag('close')} - 1 AS ret_1, {roll('avg', 'close', 5)} AS mean, (close - {roll('avg', 'close', 20)}) / {roll('stddev_pop', 'close', 20)} AS z FROM bars", r="ret_1 mean z", t="ts")
def _(spark, d):
    return W.factor_features(stored(spark, d, "daily"), "close")


@query("scan_t7_halo_mean", f"SELECT symbol, ts, {roll('avg', 'close', 20)} AS mean FROM bars", r="mean", t="ts")
def _(spark, d):
    """The rolling mean over blocks of 256 rows with copies of the 19 before equals the one over whole series."""
    return W.rolled(cut(daily(spark, d), 19, size=256), F.avg, "close", 20).withColumnRenamed("v", "mean")


@query("scan_t1_row_index", f"SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS idx FROM bars", t="ts")
def _(spark, d):
    return S.row_index(daily(spark, d)).select("symbol", "ts", "idx")


def _fold(of: str, alpha: str) -> str:
    """EMA from the first value on, by a fold over all earlier values."""
    return f"list_reduce(list({of}) {SO_FAR}, lambda a, x: a * (1 - {alpha}) + x * {alpha})"


@query("win16_ema_macd", f"WITH o AS (SELECT symbol, ts, {_fold('close', '2.0/13')} AS fast, {_fold('close', '2.0/27')} AS slow FROM bars), m AS (SELECT *, fast - slow AS macd FROM o) SELECT symbol, ts, fast, slow, macd, {_fold('macd', '2.0/10')} AS signal FROM m", r="fast slow macd signal", t="ts")
def _(spark, d):
    return R.macd(stored(spark, d, "daily"))


@query(
    "win17_wilder",
    f"WITH o AS (SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS k, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l, {_TR} AS tr, CASE WHEN high + low + close > {lag('high + low + close')} THEN (high + low + close) / 3 * volume ELSE 0 END AS up, CASE WHEN high + low + close < {lag('high + low + close')} THEN (high + low + close) / 3 * volume ELSE 0 END AS down FROM bars), s AS (SELECT symbol, avg(CASE WHEN k BETWEEN 1 AND 14 THEN up END) AS u0, avg(CASE WHEN k BETWEEN 1 AND 14 THEN down END) AS d0, avg(CASE WHEN k BETWEEN 1 AND 14 THEN g END) AS g0, avg(CASE WHEN k BETWEEN 1 AND 14 THEN l END) AS l0, avg(CASE WHEN k < 14 THEN tr END) AS t0 FROM o GROUP BY symbol), n AS (SELECT symbol, ts, k, g0, l0, t0, u0, d0, list(up) {SO_FAR} AS us, list(down) {SO_FAR} AS ds, list(g) {SO_FAR} AS gs, list(l) {SO_FAR} AS ls, list(tr) {SO_FAR} AS ts_ FROM o JOIN s USING (symbol)), w AS (SELECT symbol, ts, CASE WHEN k >= 14 THEN list_reduce(list_prepend(u0, us[16:]), lambda a, x: (a * 13 + x) / 14) END AS u, CASE WHEN k >= 14 THEN list_reduce(list_prepend(d0, ds[16:]), lambda a, x: (a * 13 + x) / 14) END AS d, CASE WHEN k >= 14 THEN list_reduce(list_prepend(g0, gs[16:]), lambda a, x: (a * 13 + x) / 14) END AS g, CASE WHEN k >= 14 THEN list_reduce(list_prepend(l0, ls[16:]), lambda a, x: (a * 13 + x) / 14) END AS l, CASE WHEN k >= 13 THEN list_reduce(list_prepend(t0, ts_[15:]), lambda a, x: (a * 13 + x) / 14) END AS atr FROM n) SELECT symbol, ts, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi, atr, CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END AS mfi FROM w",
    r="rsi atr mfi",
    t="ts",
)
def _(spark, d):
    return R.wilder(stored(spark, d, "daily"))


def _smooth(of: str, first: int, k: str = "k") -> str:
    """Wilder mean of 14 in a row: from the mean of the values from place ``first`` on, by a fold over those after."""
    at = first + 14
    return f"CASE WHEN {k} >= {at - 1} THEN list_reduce(list_prepend(list_avg({of}[{first + 1}:{at}]), {of}[{at + 1}:]), lambda a, x: (a * 13 + x) / 14) END"


@query(
    "win17_directional",
    f"WITH o AS (SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS k, {_TR} AS tr, high - {lag('high')} AS hi, {lag('low')} - low AS lo FROM bars), m AS (SELECT *, CASE WHEN hi > lo AND hi > 0 THEN hi ELSE 0 END AS p, CASE WHEN lo > hi AND lo > 0 THEN lo ELSE 0 END AS m FROM o), l AS (SELECT symbol, ts, k, list(tr) {SO_FAR} AS t, list(p) {SO_FAR} AS p, list(m) {SO_FAR} AS m FROM m), w AS (SELECT symbol, ts, k, {_smooth('t', 0)} AS t, {_smooth('p', 0)} AS p, {_smooth('m', 0)} AS m FROM l), d AS (SELECT symbol, ts, k, CASE WHEN t = 0 THEN 0 ELSE 100 * p / t END AS plus_di, CASE WHEN t = 0 THEN 0 ELSE 100 * m / t END AS minus_di, CASE WHEN t = 0 THEN NULL WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx FROM w), x AS (SELECT *, list(dx) FILTER (dx IS NOT NULL) {SO_FAR} AS xs, count(dx) {SO_FAR} - 1 AS j FROM d), a AS (SELECT symbol, ts, k, plus_di, minus_di, CASE WHEN dx IS NOT NULL THEN {_smooth('xs', 0, 'j')} END AS adx FROM x) SELECT symbol, ts, plus_di, minus_di, adx, (adx + lag(adx, 14) OVER ({BY})) / 2 AS adxr FROM a",
    r="plus_di minus_di adx adxr",
    t="ts",
)
def _(spark, d):
    return R.directional(stored(spark, d, "daily"))


@query(
    "win16_keltner",
    f"WITH o AS (SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS k, close, {_TR} AS tr FROM bars), l AS (SELECT *, list(tr) {SO_FAR} AS t, {_fold('close', '2.0/21')} AS mid FROM o), a AS (SELECT symbol, ts, mid, CASE WHEN k >= 9 THEN list_reduce(list_prepend(list_avg(t[1:10]), t[11:]), lambda a, x: (a * 9 + x) / 10) END AS atr FROM l) SELECT symbol, ts, mid + 2 * atr AS upper, mid AS middle, mid - 2 * atr AS lower FROM a",
    r="upper middle lower",
    t="ts",
)
def _(spark, d):
    return R.keltner(stored(spark, d, "daily"))


@query(
    "win16_ema_from_mean",
    f"WITH l AS (SELECT symbol, ts, row_number() OVER ({BY}) AS k, list(close) {SO_FAR} AS x FROM bars) SELECT symbol, ts, CASE WHEN k >= 20 THEN list_reduce(list_prepend(list_avg(x[1:20]), x[21:]), lambda a, x: a * (1 - 2.0 / 21) + x * 2.0 / 21) END AS ema FROM l",
    r="ema",
    t="ts",
)
def _(spark, d):
    return R.ema(stored(spark, d, "daily"), "close", 20, "ema", "mean")


_RSI = "CASE WHEN {l} = 0 THEN {z} ELSE 100 - 100 / (1 + {g} / {l}) END"


@query(
    "win28_indicator_signals",
    f"WITH o AS (SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS k, close, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l, {_TR} AS tr, {_fold('close', '2.0/13')} - {_fold('close', '2.0/27')} AS macd FROM bars), p AS (SELECT *, list(g) {SO_FAR} AS gs, list(l) {SO_FAR} AS ls, macd - {_fold('macd', '2.0/10')} AS h FROM o), q AS (SELECT *, {lag('h')} AS h0, {_smooth('gs', 1)} AS up, {_smooth('ls', 1)} AS down, CASE WHEN k >= 1 THEN list_reduce(gs[2:], lambda a, x: a * 13.0 / 14 + x / 14) END AS eg, CASE WHEN k >= 1 THEN list_reduce(ls[2:], lambda a, x: a * 13.0 / 14 + x / 14) END AS el, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 50)} AS m50, {roll('stddev_pop', 'close', 20)} AS sd, {roll('avg', 'tr', 14)} AS atr FROM p), r AS (SELECT *, {_RSI.format(l='down', g='up', z='100')} AS rsi, {_RSI.format(l='el', g='eg', z='CASE WHEN eg > 0 THEN 100 END')} AS rs, {roll('avg', 'atr', 20)} AS atr20 FROM q), v AS (SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS a, CASE WHEN k < 34 THEN 0 WHEN h > 0 AND h0 <= 0 THEN 1 WHEN h < 0 AND h0 >= 0 THEN -1 ELSE 0 END AS b, CASE WHEN close < m20 - 2 * sd THEN 1 WHEN close > m20 + 2 * sd THEN -1 ELSE 0 END AS c FROM r), w AS (SELECT *, CASE WHEN k >= 35 THEN (a = 1)::INT + (b = 1)::INT + (c = 1)::INT ELSE 0 END AS buys, CASE WHEN k >= 35 THEN (a = -1)::INT + (b = -1)::INT + (c = -1)::INT ELSE 0 END AS sells FROM v) SELECT symbol, ts, a AS rsi_signal, b AS macd_signal, c AS band_signal, CASE WHEN buys >= 2 THEN 1 WHEN sells >= 2 THEN -1 ELSE 0 END AS ensemble, CASE WHEN buys >= 2 THEN buys / 3.0 WHEN sells >= 2 THEN sells / 3.0 END AS confidence, CASE WHEN k >= 14 AND atr > atr20 AND m20 > m50 AND rs > 50 THEN 1 WHEN k >= 14 AND atr > atr20 AND m20 < m50 AND rs < 50 THEN -1 ELSE 0 END AS multi_signal FROM w",
    r="confidence",
    t="ts",
)
def _(spark, d):
    return G.indicator_signals(stored(spark, d, "daily"))


@query("win18_kalman", f"WITH RECURSIVE n AS (SELECT symbol, ts, close, row_number() OVER ({BY}) AS k FROM bars), x AS (SELECT symbol, k, close AS trend, 1.0::DOUBLE AS p FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.k, x.trend + (x.p + 0.01) / (x.p + 1.01) * (n.close - x.trend), (x.p + 0.01) * (1 - (x.p + 0.01) / (x.p + 1.01)) FROM x JOIN n ON n.symbol = x.symbol AND n.k = x.k + 1) SELECT symbol, ts, trend FROM x JOIN n USING (symbol, k)", r="trend", t="ts")
def _(spark, d):
    return R.kalman(stored(spark, d, "daily"))


@query(
    "win42_garch",
    f"WITH v AS (SELECT symbol, ts, 0.0001 + 0.1 * {lag('r')} * {lag('r')} AS b FROM rets WHERE r IS NOT NULL), l AS (SELECT symbol, ts, list(coalesce(b, 0.0001 / (1 - 0.1 - 0.85))) {SO_FAR} AS bs FROM v) SELECT symbol, ts, list_reduce(bs, lambda a, x: a * 0.85 + x) AS variance FROM l",
    use="rets",
    r="variance",
    t="ts",
)
def _(spark, d):
    return R.garch(with_returns(daily(spark, d)).where("r is not null"), "r", 0.0001, 0.1, 0.85)


@query("win19_supertrend_psar", None, r="supertrend sar", t="ts")
def _(spark, d):
    return R.path_dependent(stored(spark, d, "daily"))


@query("win32_forward_labels", f"WITH o AS (SELECT symbol, ts, lead(close, 5) OVER ({BY}) / close - 1 AS fwd, {roll('stddev_samp', 'r', 20)} AS sd FROM rets) SELECT symbol, ts, fwd, (fwd > 0)::INT AS up, CASE WHEN fwd > 0.02 THEN 1 WHEN fwd < -0.02 THEN -1 WHEN fwd IS NOT NULL THEN 0 END AS class, CASE WHEN sd > 0 THEN fwd / sd END AS vol_adjusted FROM o", use="rets", r="fwd vol_adjusted", t="ts")
def _(spark, d):
    return L.forward_labels(stored(spark, d, "daily"), 5)


@query("win31_triple_barrier", f"WITH o AS (SELECT symbol, ts, close, list(close) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM bars), h AS (SELECT symbol, ts, list_filter(list_transform(n, lambda x: x / close - 1), lambda m: m >= 0.1 OR m <= -0.1) AS hit FROM o WHERE len(n) = 10) SELECT symbol, ts, CASE WHEN len(hit) = 0 THEN 0 WHEN hit[1] >= 0.1 THEN 1 ELSE -1 END AS label FROM h", t="ts")
def _(spark, d):
    return L.triple_barrier(stored(spark, d, "daily"), 0.1, 0.1, 10)


_NEXT = f"OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query("win45_bar_outcomes", f"WITH o AS (SELECT symbol, ts, CASE WHEN count(*) {_NEXT} = 5 THEN lead(close, 5) OVER ({BY}) / close - 1 END AS ret, CASE WHEN count(*) {_NEXT} = 5 THEN max(high) {_NEXT} / close - 1 END AS mfe, CASE WHEN count(*) {_NEXT} = 5 THEN min(low) {_NEXT} / close - 1 END AS mae FROM bars) SELECT symbol, ts, ret, mfe, mae, ret - 0.002 AS net, (ret - 0.002 > 0)::INT AS win FROM o", r="ret mfe mae net", t="ts")
def _(spark, d):
    return L.bar_outcomes(stored(spark, d, "daily"), 5, 0.001)


_TRADES = f"act AS (SELECT symbol, ts, price, CASE WHEN direction = 'bullish' THEN 'BUY' ELSE 'SELL' END AS action FROM ev WHERE direction IS NOT NULL), f AS (SELECT *, {lag('action')} AS p FROM act), g AS (SELECT *, row_number() OVER ({BY}) AS rn FROM f WHERE p IS NULL OR p <> action), h AS (SELECT * FROM g WHERE rn > 1 OR action = 'BUY'), j AS (SELECT *, lead(ts) OVER ({BY}) AS x, lead(price) OVER ({BY}) AS xp FROM h), last AS (SELECT symbol, max(ts) AS e, arg_max(price, ts) AS ep FROM act GROUP BY symbol), tr AS (SELECT symbol, ts AS entry_ts, price AS entry, coalesce(x, e) AS exit_ts, coalesce(xp, ep) AS exit FROM j JOIN last USING (symbol) WHERE action = 'BUY')"


def _trades(spark, d):
    e = W.crossovers(stored(spark, d, "daily"))
    return L.first_of_runs(e.select("symbol", "ts", "price", F.when(F.col("direction") == "bullish", "BUY").otherwise("SELL").alias("action")))


@query("win30_trades", f"WITH {CROSS}, {_TRADES} SELECT symbol, entry_ts, entry, exit_ts, exit FROM tr", r="entry exit", t="entry_ts exit_ts")
def _(spark, d):
    return _trades(spark, d)


@query("agg58_trade_summary", f"WITH {CROSS}, {_TRADES}, z AS (SELECT symbol, exit_ts, (exit * 0.999 - entry) / entry AS pnl FROM tr), e AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol ORDER BY exit_ts)) AS eq FROM z), d AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts)) - 1 AS dd FROM e) SELECT symbol, count(*) AS trades, avg(pnl) AS mean, sum(pnl) AS total, max(pnl) AS best, avg((pnl > 0)::INT) AS win_rate, CASE WHEN count(*) > 1 THEN avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(252) ELSE 0 END AS sharpe, min(dd) AS max_drawdown FROM d GROUP BY symbol", r="mean total best win_rate sharpe max_drawdown")
def _(spark, d):
    trades = keep(_trades(spark, d))
    return L.trade_summary(trades, 0.001).join(L.trade_drawdown(trades, 0.001), "symbol")