"""Queries: statistics, risk, joins, events and their outcomes, checks, folds and tests, lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import folds as V
from tidemark.operators import labels as L
from tidemark.operators import lineage as G
from tidemark.operators import quality as Q
from tidemark.operators import regress as M
from tidemark.operators import relations as X
from tidemark.operators import resample as Z
from tidemark.operators import risk as K
from tidemark.operators import scan as S
from tidemark.operators import stats as T
from tidemark.operators import windows as W
from tidemark.operators.recursive import change_points
from tidemark.plans.registry import BY, NORMAL_P, daily, factors, full, hourly, lag, over, p_value, query, read, roll, stored, ticks, with_returns
from tidemark.plans.window_queries import CROSS, SO_FAR
from tidemark.sources.scratch import stored as keep

R = "rets WHERE r IS NOT NULL"


def _returns(spark, d):
    return with_returns(daily(spark, d)).where("r is not null")


# --- statistics -------------------------------------------------------------------------------------------------


@query(
    "agg05_descriptive",
    f"SELECT symbol, count(r) AS n, avg(r) AS mean, quantile_cont(r, 0.5) AS median, var_samp(r) AS var_samp, var_pop(r) AS var_pop, avg(((r - m) / s) ** 3) AS skew, avg(((r - m) / s) ** 3) * count(*) * count(*) / ((count(*) - 1) * (count(*) - 2)) AS skew_adjusted, avg(((r - m) / s) ** 4) - 3 AS kurtosis, min(r) AS lo, max(r) AS hi, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr FROM (SELECT symbol, ln(1 + r) AS r, avg(ln(1 + r)) OVER (PARTITION BY symbol) AS m, stddev_pop(ln(1 + r)) OVER (PARTITION BY symbol) AS s FROM {R}) GROUP BY symbol",
    use="rets",
    r="mean median var_samp var_pop skew skew_adjusted kurtosis lo hi q1 q3 iqr",
)
def _(spark, d):
    return T.descriptive(_returns(spark, d).withColumn("r", F.log(1 + F.col("r"))), "r")


@query("agg07_histogram", "WITH e AS (SELECT symbol, min(close) lo, max(close) hi FROM bars GROUP BY symbol) SELECT symbol, least(19, floor((close - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM bars JOIN e USING (symbol) GROUP BY 1, 2")
def _(spark, d):
    return T.histogram(daily(spark, d), "close", 20)


_COLS = ["c_click", "c_error", "c_purchase", "c_signup", "c_view"]


def _wide(spark, d):
    return factors(spark, d).groupBy("day").pivot("series_id", [c[2:] for c in _COLS]).agg(F.first("value")).toDF("day", *_COLS)


_WIDE = "SELECT day, " + ", ".join(f"max(CASE WHEN series_id = '{c[2:]}' THEN value END) AS {c}" for c in _COLS) + " FROM factors GROUP BY day"


@query("joi02_pivot", _WIDE, use="factors", r=" ".join(_COLS), t="day")
def _(spark, d):
    return _wide(spark, d)


@query(
    "agg21_correlation_matrix",
    f"WITH w AS ({_WIDE}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, covar_samp({a}, {b}) AS covar, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM w" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]),
    use="factors",
    r="corr covar",
)
def _(spark, d):
    return T.pearson_matrix(_wide(spark, d), _COLS)


@query(
    "agg22_spearman",
    "WITH r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY high) + (count(*) OVER (PARTITION BY symbol, high) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS b FROM bars) SELECT symbol, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY symbol",
    r="rho",
)
def _(spark, d):
    return T.spearman(daily(spark, d), "high", "volume")


@query("agg24_regime_correlation", "SELECT symbol, close > open AS regime, CASE WHEN count(*) >= 30 THEN corr(high, low) END AS corr, count(*) AS n FROM bars GROUP BY 1, 2", r="corr")
def _(spark, d):
    return X.regime_correlation(daily(spark, d).withColumn("regime", F.col("close") > F.col("open")), "high", "low", "regime", 30)


@query(
    "agg25_regression",
    "WITH f AS (SELECT symbol, count(*) AS n, regr_slope(high, low) AS slope, regr_intercept(high, low) AS intercept, regr_r2(high, low) AS r2, regr_sxx(high, low) AS sxx, regr_sxy(high, low) AS sxy, regr_syy(high, low) AS syy FROM bars GROUP BY symbol) SELECT symbol, n, slope, intercept, r2, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS residual_sd FROM f",
    r="slope intercept r2 residual_sd",
)
def _(spark, d):
    return T.regression(daily(spark, d), "high", "low")


@query(
    "agg26_two_factor_regression",
    "WITH s AS (SELECT symbol, count(*) AS n, var_pop(low) a, var_pop(volume) b, covar_pop(low, volume) c, covar_pop(low, high) p, covar_pop(volume, high) q, var_pop(high) v, avg(low) ml, avg(volume) mv, avg(high) mh FROM bars GROUP BY symbol), k AS (SELECT *, (p * b - q * c) / (a * b - c * c) AS b1, (q * a - p * c) / (a * b - c * c) AS b2 FROM s) SELECT symbol, n, mh - b1 * ml - b2 * mv AS intercept, b1 AS beta_low, b2 AS beta_volume, (b1 * p + b2 * q) / v AS r2 FROM k",
    r="intercept beta_low beta_volume r2",
)
def _(spark, d):
    fit = M.least_squares(daily(spark, d), "high", ["low", "volume"])
    return fit.select("symbol", "n", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("beta_low"), F.col("beta")[2].alias("beta_volume"), "r2")


def _orthogonal(source: str, key: str, columns: list[str]) -> str:
    """Common tables in which every column is centred and freed of those before it, group by group; ends in ``orth``."""
    w = f"OVER (PARTITION BY {key})"
    out = [f"o0 AS (SELECT {key}, " + ", ".join(f"{c} - avg({c}) {w} AS {c}" for c in columns) + f" FROM {source})"]
    for i, c in enumerate(columns[:-1]):
        rest = ", ".join(f"{x} - {c} * (sum({x} * {c}) {w} / sum({c} * {c}) {w}) AS {x}" for x in columns[i + 1 :])
        out.append(f"o{i + 1} AS (SELECT {key}, {', '.join(columns[: i + 1])}, {rest} FROM o{i})")
    return ", ".join(out) + f", orth AS (SELECT * FROM o{len(columns) - 1})"


def _t_statistic(y: str, x: str, k: int) -> str:
    """t statistic of the slope of y on x, both freed of the other regressors; k coefficients in all."""
    return f"(sum({x} * {y}) / sum({x} * {x})) / sqrt((sum({y} * {y}) - sum({x} * {y}) ** 2 / sum({x} * {x})) / (count(*) - {k}) / sum({x} * {x}))"


@query("agg27_polynomial", f"WITH p AS (SELECT symbol, low AS a, low ** 2 AS b, low ** 3 AS c, high AS y FROM bars), {_orthogonal('p', 'symbol', ['a', 'b', 'c', 'y'])}, v AS (SELECT symbol, var_pop(y) * count(*) AS total FROM p GROUP BY 1) SELECT symbol, count(*) AS n, 1 - sum(y * y) / min(total) AS r2 FROM orth JOIN v USING (symbol) GROUP BY 1", r="r2")
def _(spark, d):
    return M.polynomial(daily(spark, d), "high", "low", 3).select("symbol", "n", "r2")


_PRED = "p AS (SELECT event_id % 5 AS fold, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS p, value, CASE WHEN value > median(value) OVER (PARTITION BY event_type) THEN 1 ELSE 0 END AS actual FROM events)"


def _predictions(spark, d):
    e = read(spark, d, "events")
    mid = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    return e.join(F.broadcast(mid), "event_type").select((F.col("event_id") % 5).alias("fold"), ((F.col("event_id") * 7919 % 1000) / 1000).alias("p"), "value", (F.col("value") > F.col("mid")).cast("int").alias("actual"))


@query(
    "agg29_classification",
    f"WITH {_PRED}, c AS (SELECT fold, sum((actual = 1 AND p >= 0.5)::INT)::DOUBLE tp, sum((actual = 0 AND p >= 0.5)::INT)::DOUBLE fp, sum((actual = 1 AND p < 0.5)::INT)::DOUBLE fn, sum((actual = 0 AND p < 0.5)::INT)::DOUBLE tn FROM p GROUP BY fold), e AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM e",
    use="",
    r="tp fp fn tn accuracy precision recall f1",
)
def _(spark, d):
    return T.confusion(_predictions(spark, d).withColumn("y", (F.col("p") >= 0.5).cast("int")), "actual", "y", "fold")


@query("agg30_errors", f"WITH {_PRED} SELECT fold, avg(abs(p - value)) AS mae, avg((p - value) ** 2) AS mse, sqrt(avg((p - value) ** 2)) AS rmse, avg(p - value) AS bias, avg((sign(value) = sign(p))::INT) AS directional FROM p GROUP BY fold", use="", r="mae mse rmse bias directional")
def _(spark, d):
    return T.errors(_predictions(spark, d), "value", "p", "fold")


@query(
    "agg31_brier_log_loss",
    f"WITH {_PRED}, c AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS q FROM p) SELECT fold, avg((p - actual) ** 2) AS brier, avg(-(actual * ln(q) + (1 - actual) * ln(1 - q))) AS log_loss FROM c GROUP BY fold",
    use="",
    r="brier log_loss",
)
def _(spark, d):
    return T.probability_scores(_predictions(spark, d), "p", "actual", "fold")


@query("agg32_reliability", f"WITH {_PRED}, b AS (SELECT fold, least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(actual) AS observed FROM p GROUP BY 1, 2) SELECT *, (bin + 0.5) / 10 AS midpoint, abs(observed - (bin + 0.5) / 10) AS gap FROM b", use="", r="observed midpoint gap")
def _(spark, d):
    return T.reliability(_predictions(spark, d), "p", "actual", "fold")


_Z = "1.959963984540054"
_WILSON = "(k * 1.0 / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) {s} {z} / (1 + {z} * {z} / n) * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + {z} * {z} / (4.0 * n * n))"


@query("agg33_wilson", f"WITH c AS (SELECT symbol, sum((r > 0)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM {R} GROUP BY symbol) SELECT symbol, k::BIGINT AS k, n::BIGINT AS n, {_WILSON.format(z=_Z, s='-')} AS lo, {_WILSON.format(z=_Z, s='+')} AS hi FROM c", use="rets", r="lo hi")
def _(spark, d):
    c = _returns(spark, d).groupBy("symbol").agg(F.count_if(F.col("r") > 0).alias("k"), F.count("*").alias("n"))
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    return c.select("symbol", "k", "n", lo.alias("lo"), hi.alias("hi"))


@query("agg34_sign_test", f"WITH {_PRED}, e AS (SELECT fold, sum((a AND NOT b)::INT)::BIGINT AS wins, sum((b AND NOT a)::INT)::BIGINT AS losses FROM (SELECT fold, (p >= 0.5)::INT = actual AS a, actual = 1 AS b FROM p) GROUP BY fold) SELECT fold, wins, losses FROM e", use="")
def _(spark, d):
    own = _predictions(spark, d).select("fold", ((F.col("p") >= 0.5).cast("int") == F.col("actual")).alias("a"), (F.col("actual") == 1).alias("b"))
    return X.sign_test(own, "a", "b", "fold").drop("p")


@query("agg34_sign_test_p_values", f"WITH {_PRED}, e AS (SELECT fold, sum((a AND NOT b)::INT)::BIGINT AS wins, sum((b AND NOT a)::INT)::BIGINT AS losses FROM (SELECT fold, (p >= 0.5)::INT = actual AS a, actual = 1 AS b FROM p) GROUP BY fold) SELECT fold, wins, losses, CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(generate_series(0, least(wins, losses)), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END AS p FROM e", use="", r="p")
def _(spark, d):
    own = _predictions(spark, d).select("fold", ((F.col("p") >= 0.5).cast("int") == F.col("actual")).alias("a"), (F.col("actual") == 1).alias("b"))
    return X.sign_test(own, "a", "b", "fold")


@query("agg35_entropy", "WITH j AS (SELECT o_orderpriority x, o_orderstatus y, count(*)::DOUBLE n FROM orders GROUP BY 1, 2), p AS (SELECT x, y, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM j) SELECT -sum(p * log2(px)) AS h_x, -sum(p * log2(py)) AS h_y, sum(p * log2(p / (px * py))) AS mutual_information FROM p", use="", r="h_x h_y mutual_information")
def _(spark, d):
    return T.entropy(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


_TESTS = f"SELECT {{by}}, n, mean, sd, t, CASE WHEN t IS NOT NULL THEN {p_value('t', '(n - 1)')} END AS t_p, z, {NORMAL_P.format(t='z')} AS z_p, mean / nullif(sd, 0) AS effect, mean - {_Z} * sd / sqrt(n) AS lo, mean + {_Z} * sd / sqrt(n) AS hi FROM (SELECT *, mean / nullif(sd / sqrt(n), 0) AS t, mean / nullif(s0 / sqrt(n), 0) AS z FROM c)"


@query("agg36_mean_tests", f"WITH c AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS s0 FROM {R} GROUP BY symbol) {_TESTS.format(by='symbol')}", use="rets", r="mean sd t t_p z z_p effect lo hi")
def _(spark, d):
    return T.mean_tests(_returns(spark, d), "r", "symbol")


@query("agg36_small_groups", f"WITH c AS (SELECT symbol, date_trunc('month', ts) AS month, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS s0 FROM {R} GROUP BY 1, 2) {_TESTS.format(by='symbol, month')}", use="rets", r="mean sd t t_p z z_p effect lo hi", t="month")
def _(spark, d):
    """One test a month: few rows, by Student's law."""
    return T.mean_tests(_returns(spark, d).withColumn("month", F.date_trunc("month", "ts")), "r", ["symbol", "month"])


@query("agg37_distribution_fits", "SELECT symbol, avg(close) AS mu, stddev_samp(close) AS sigma, avg(ln(close)) AS log_mu, stddev_samp(ln(close)) AS log_sigma FROM bars GROUP BY symbol", r="mu sigma log_mu log_sigma")
def _(spark, d):
    return T.log_normal(daily(spark, d), "close", "symbol")


@query("agg38_density", "SELECT symbol, g.x::DOUBLE AS \"at\", avg((close <= g.x)::INT) AS cdf, avg(exp(-0.5 * ((close - g.x) / 20) ** 2)) / (20 * sqrt(2 * pi())) AS density FROM bars, (VALUES (100), (200), (300), (400)) AS g(x) GROUP BY 1, 2", r="at cdf density")
def _(spark, d):
    return T.density(daily(spark, d), "close", [100, 200, 300, 400], 20, "symbol")


_STATE = "CASE WHEN r > 0.5 THEN 'up' WHEN r < -0.3 THEN 'down' ELSE 'flat' END"


def _states(spark, d):
    return _returns(spark, d).withColumn("state", F.when(F.col("r") > 0.5, "up").when(F.col("r") < -0.3, "down").otherwise("flat"))


@query(
    "agg39_transitions",
    f"WITH s AS (SELECT symbol, {_STATE} AS a, lead({_STATE}) OVER ({BY}) AS b FROM {R}), c AS (SELECT symbol, a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL), g AS (SELECT DISTINCT symbol, x.v AS a, y.v AS b FROM s, (VALUES ('up'), ('down'), ('flat')) AS x(v), (VALUES ('up'), ('down'), ('flat')) AS y(v)) SELECT symbol, a AS \"from\", b AS \"to\", coalesce(n, 0) AS n, CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY symbol, a) = 0 THEN 1.0 / 3 ELSE coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY symbol, a) END AS p FROM g LEFT JOIN c USING (symbol, a, b)",
    use="rets",
    r="p",
)
def _(spark, d):
    return T.transitions(_states(spark, d), "state", ["up", "down", "flat"])


@query("agg41_beta_posterior", f"SELECT symbol, 1 + sum((r > 0)::INT) AS a, 1 + sum((r <= 0)::INT) AS b, (1 + sum((r > 0)::INT)) / (2.0 + count(*)) AS mean FROM {R} GROUP BY symbol", use="rets", r="a b mean")
def _(spark, d):
    return X.beta_posterior(_returns(spark, d).withColumn("hit", F.col("r") > 0), "hit", "symbol")


@query("agg10_conditional_statistics", f"WITH {CROSS}, f AS (SELECT ev.direction, lead(b.close, 5) OVER (PARTITION BY b.symbol ORDER BY b.ts) / b.close - 1 AS fwd FROM bars b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.ts = b.ts AND ev.direction IS NOT NULL) SELECT direction, count(fwd) AS n, avg((fwd > 0)::INT) AS p_up, avg(fwd) AS mean, stddev_pop(fwd) AS sd, CASE WHEN count(fwd) >= 5 THEN 'ok' ELSE 'insufficient' END AS status FROM f WHERE direction IS NOT NULL AND fwd IS NOT NULL GROUP BY 1", r="p_up mean sd")
def _(spark, d):
    bars = daily(spark, d)
    events = W.crossovers(bars).select("symbol", "ts", "direction")
    return T.conditional(L.forward_labels(bars, 5).join(events, ["symbol", "ts"]), "fwd", "direction")


@query("agg11_event_study_grouping_sets", f"WITH {CROSS}, f AS (SELECT year(ev.ts) AS y, ev.direction, lead(b.close, 5) OVER (PARTITION BY b.symbol ORDER BY b.ts) / b.close - 1 AS fwd FROM bars b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.ts = b.ts AND ev.direction IS NOT NULL) SELECT coalesce(y::VARCHAR, 'ALL') AS year, direction, count(*) AS n, avg(fwd) AS gross, avg(fwd - 0.002) AS net, avg((fwd - 0.002 > 0)::INT) AS win_rate FROM f WHERE direction IS NOT NULL AND fwd IS NOT NULL GROUP BY GROUPING SETS ((y, direction), (direction))", r="gross net win_rate")
def _(spark, d):
    bars = daily(spark, d)
    return X.event_study(L.forward_labels(bars, 5).join(W.crossovers(bars).select("symbol", "ts", "direction"), ["symbol", "ts"]).where("fwd is not null"), 0.002)


@query("agg12_seasonality", f"WITH i AS (SELECT symbol, r, (row_number() OVER ({BY}) - 1) % 12 AS season FROM {R}) SELECT symbol, season, count(*) AS n, avg(r) AS mean, avg((r > 0)::INT) AS hit FROM i GROUP BY 1, 2", use="rets", r="mean hit")
def _(spark, d):
    return X.seasonality(_returns(spark, d), "r", 12)


@query("agg14_patterns", f"WITH l AS (SELECT symbol, {' || '.join(f'''CASE WHEN lead(r, {k}) OVER ({BY}) > 0 THEN 'U' ELSE 'D' END''' for k in range(3))} AS pattern, lead(r, 3) OVER ({BY}) AS after FROM {R}), c AS (SELECT symbol, pattern, count(*) AS n FROM l WHERE after IS NOT NULL GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY symbol) AS share FROM c", use="rets", r="share")
def _(spark, d):
    return T.patterns(_returns(spark, d), "r", 3)


_RUNS = f"a AS (SELECT symbol, ts, sign(r)::INT AS s FROM {R}), b AS (SELECT *, CASE WHEN {lag('s')} IS DISTINCT FROM s THEN 1 ELSE 0 END AS w FROM a), c AS (SELECT *, sum(w) {SO_FAR} AS run FROM b), g AS (SELECT symbol, run, count(*) AS length, min(s) AS sign, run = max(run) OVER (PARTITION BY symbol) AS is_open FROM c GROUP BY symbol, run)"


@query("agg15_streak_lengths", f"WITH {_RUNS} SELECT symbol, sign, length, count(*) AS n FROM g WHERE NOT is_open AND sign <> 0 GROUP BY 1, 2, 3", use="rets")
def _(spark, d):
    return T.streaks(_returns(spark, d), "r").where("not is_open and sign <> 0").groupBy("symbol", "sign", "length").agg(F.count("*").alias("n"))


@query("agg16_longest_runs", f"WITH {_RUNS} SELECT symbol, max(CASE WHEN sign = 1 THEN length END) AS wins, max(CASE WHEN sign = -1 THEN length END) AS losses FROM g GROUP BY 1", use="rets")
def _(spark, d):
    return T.streaks(_returns(spark, d), "r").groupBy("symbol").agg(F.max(F.when(F.col("sign") == 1, F.col("length"))).alias("wins"), F.max(F.when(F.col("sign") == -1, F.col("length"))).alias("losses"))


@query("agg17_win_loss", f"SELECT symbol, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg((r < 0)::INT) AS loss_rate, avg(r) FILTER (WHERE r > 0) AS mean_win, avg(r) FILTER (WHERE r < 0) AS mean_loss, avg(r) FILTER (WHERE r > 0) / -avg(r) FILTER (WHERE r < 0) AS payoff, sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0) AS profit_factor, avg((r > 0)::INT) AS consistency FROM {R} GROUP BY 1", use="rets", r="win_rate loss_rate mean_win mean_loss payoff profit_factor consistency")
def _(spark, d):
    return K.win_loss(_returns(spark, d), "r")


@query("agg18_ratios", f"SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS sortino, sum(greatest(r, 0)) / sum(greatest(-r, 0)) AS omega FROM {R} GROUP BY 1", use="rets", r="sharpe sortino omega")
def _(spark, d):
    return K.ratios(_returns(spark, d), "r")


@query("agg18_calmar", f"WITH m AS (SELECT symbol, avg(r) AS m FROM {R} GROUP BY 1), p AS (SELECT symbol, close / max(close) {SO_FAR} - 1 AS dd FROM bars), w AS (SELECT symbol, min(dd) AS max_drawdown FROM p GROUP BY 1) SELECT symbol, max_drawdown, CASE WHEN max_drawdown = 0 THEN 0 ELSE m * 252 / abs(max_drawdown) END AS calmar FROM m JOIN w USING (symbol)", use="rets", r="max_drawdown calmar")
def _(spark, d):
    return K.calmar(with_returns(daily(spark, d)), "r", "close")


@query("agg19_tail_risk", f"WITH k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM {R}) SELECT symbol, -max(r) AS var, -avg(r) AS expected_shortfall FROM k WHERE k <= floor(0.05::DOUBLE * n) + 1 GROUP BY 1", use="rets", r="var expected_shortfall")
def _(spark, d):
    return K.tail_risk(_returns(spark, d), "r")


@query("agg20_benchmark", f"WITH m AS (SELECT ts, avg(r) AS m FROM {R} GROUP BY ts), j AS (SELECT symbol, r, m FROM (SELECT * FROM {R}) JOIN m USING (ts)), b AS (SELECT symbol, count(*) AS n, covar_samp(r, m) / var_samp(m) AS beta, avg(r) AS a, avg(m) AS c, avg(r - m) AS e, stddev_samp(r - m) AS s FROM j GROUP BY 1) SELECT symbol, n, beta, a - beta * c AS alpha, a * 252 / beta AS treynor, e / s * sqrt(252) AS information FROM b", use="rets", r="beta alpha treynor information")
def _(spark, d):
    r = _returns(spark, d)
    return K.benchmark(r.join(r.groupBy("ts").agg(F.avg("r").alias("m")), "ts"), "r", "m")


_DD = f"q AS (SELECT symbol, ts, close AS equity, max(close) {SO_FAR} AS peak FROM bars), dd AS (SELECT *, equity / peak - 1 AS drawdown, sum((equity = peak)::INT) {SO_FAR} AS episode FROM q)"


@query("win23_drawdowns", f"WITH {_DD} SELECT symbol, ts, equity, peak, drawdown, episode::BIGINT AS episode FROM dd", r="equity peak drawdown", t="ts")
def _(spark, d):
    return K.drawdowns(stored(spark, d, "daily"), "close")


@query("win24_drawdown_episodes", f"WITH {_DD}, e AS (SELECT symbol, episode::BIGINT AS episode, min(drawdown) AS depth, count(*) - 1 AS length, episode = max(episode) OVER (PARTITION BY symbol) AS is_open FROM dd GROUP BY symbol, dd.episode) SELECT *, length + 1 AS recovery FROM e WHERE depth < 0 OR is_open", r="depth")
def _(spark, d):
    return K.episodes(K.drawdowns(stored(spark, d, "daily"), "close"))


@query("win24_recovery", f"WITH {_DD}, e AS (SELECT symbol, episode, min(drawdown) AS depth, count(*) AS recovery, episode = max(episode) OVER (PARTITION BY symbol) AS is_open FROM dd GROUP BY symbol, dd.episode) SELECT symbol, count(*) AS n, min(depth) AS max_drawdown, avg(depth) AS mean_drawdown, avg(recovery) AS mean_recovery, max(recovery) AS longest_recovery, min(recovery) AS shortest_recovery, count(*) FILTER (is_open) AS open FROM e WHERE recovery > 1 AND (depth < 0 OR is_open) GROUP BY 1", r="max_drawdown mean_drawdown mean_recovery")
def _(spark, d):
    return K.drawdown_statistics(K.episodes(K.drawdowns(stored(spark, d, "daily"), "close")))


@query("agg43_inverse_risk", f"WITH v AS (SELECT symbol, stddev_samp(r) AS volatility FROM {R} GROUP BY 1) SELECT symbol, volatility, 1 / volatility / sum(1 / volatility) OVER () AS weight FROM v WHERE volatility > 0", use="rets", r="volatility weight")
def _(spark, d):
    return K.inverse_risk(_returns(spark, d), "r")


@query("agg43_portfolio_returns", f"SELECT ts, sum(r * CASE symbol WHEN '1-URGENT' THEN 0.5 WHEN '5-LOW' THEN 0.3 ELSE 0.2 END) AS r, count(r) AS n FROM {R} AND symbol IN ('1-URGENT', '5-LOW', '2-HIGH') GROUP BY ts", use="rets", r="r", t="ts")
def _(spark, d):
    weights = spark.createDataFrame([("1-URGENT", 0.5), ("5-LOW", 0.3), ("2-HIGH", 0.2)], "symbol string, w double")
    return K.portfolio(_returns(spark, d), F.broadcast(weights))


@query("agg44_exposure", "SELECT o_orderpriority AS desk, sum(greatest(v, 0)) AS long, sum(least(v, 0)) AS short, sum(abs(v)) AS gross, sum(v) AS net FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * o_totalprice / 997 AS v FROM orders) GROUP BY 1", use="", r="long short gross net", digits=2)
def _(spark, d):
    o = read(spark, d, "orders")
    return K.exposure(o.select(F.col("o_orderpriority").alias("desk"), (F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1) * F.col("o_totalprice") / 997).alias("value")), "desk")


@query("agg46_calendar_density", "SELECT event_type AS indicator, date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1, 2", use="", t="week")
def _(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("indicator"), F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"))


@query("agg49_null_counts", f"WITH o AS (SELECT {lag('close')} AS a, {lag('close', 20)} AS b, lead(close, 5) OVER ({BY}) AS c FROM bars) SELECT 'lag1' AS \"column\", sum((a IS NULL)::INT)::BIGINT AS bad, count(*) AS n FROM o UNION ALL SELECT 'lag20', sum((b IS NULL)::INT), count(*) FROM o UNION ALL SELECT 'lead5', sum((c IS NULL)::INT), count(*) FROM o")
def _(spark, d):
    w = W.series()
    return Q.null_counts(daily(spark, d).select(F.lag("close").over(w).alias("lag1"), F.lag("close", 20).over(w).alias("lag20"), F.lead("close", 5).over(w).alias("lead5")), ["lag1", "lag20", "lead5"])


@query("agg51_autocorrelation", f"WITH c AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS c FROM {R}), p AS (SELECT symbol, c, c * {lag('c', 1)} AS p1, c * {lag('c', 2)} AS p2, c * {lag('c', 3)} AS p3 FROM c), a AS (SELECT symbol, count(*) AS n, sum(p1) / sum(c * c) AS a1, sum(p2) / sum(c * c) AS a2, sum(p3) / sum(c * c) AS a3 FROM p GROUP BY 1) SELECT symbol, n, a1, a2, a3, n * (n + 2) * (a1 * a1 / (n - 1) + a2 * a2 / (n - 2) + a3 * a3 / (n - 3)) AS ljung_box FROM a", use="rets", r="a1 a2 a3 ljung_box")
def _(spark, d):
    a = T.autocorrelation(_returns(spark, d), "r", 3)
    return a.select("symbol", "n", *[F.col("acf")[k].alias(f"a{k + 1}") for k in range(3)], "ljung_box")


@query("agg52_partial_autocorrelation", f"WITH c AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS e FROM {R}), l AS (SELECT symbol, e, {lag('e')} AS e1, {lag('e', 2)} AS e2, {lag('e', 3)} AS e3 FROM c), a AS (SELECT symbol, sum(e * e1) / sum(e * e) AS r1, sum(e * e2) / sum(e * e) AS r2, sum(e * e3) / sum(e * e) AS r3 FROM l GROUP BY 1), p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS f FROM a) SELECT symbol, r1 AS pacf1, f AS pacf2, (r3 - r1 * (1 - f) * r2 - f * r1) / (1 - r1 * (1 - f) * r1 - f * r2) AS pacf3 FROM p", use="rets", r="pacf1 pacf2 pacf3")
def _(spark, d):
    p = M.partial_autocorrelation(T.autocorrelation(_returns(spark, d), "r", 3))
    return p.select("symbol", *[F.col("pacf")[k].alias(f"pacf{k + 1}") for k in range(3)])


@query("agg53_residual_diagnostics", f"WITH e AS (SELECT symbol, ts, high - (regr_intercept(high, low) OVER (PARTITION BY symbol) + regr_slope(high, low) OVER (PARTITION BY symbol) * low) AS e FROM bars), z AS (SELECT *, e - {lag('e')} AS de, avg(e) OVER (PARTITION BY symbol) AS m, stddev_pop(e) OVER (PARTITION BY symbol) AS s FROM e) SELECT symbol, count(*) AS n, sum(de * de) / sum(e * e) AS durbin_watson, count(*) / 6.0 * (avg(((e - m) / s) ** 3) ** 2 + (avg(((e - m) / s) ** 4) - 3) ** 2 / 4) AS jarque_bera FROM z GROUP BY 1", r="durbin_watson jarque_bera")
def _(spark, d):
    return M.residual_diagnostics(M.residuals(daily(spark, d), "high", ["low"]))


@query("agg54_adf", f"WITH d AS (SELECT symbol, ts, close - {lag('close')} AS d, {lag('close')} AS level FROM bars), l AS (SELECT symbol, d, level, {lag('d')} AS d1, {lag('d', 2)} AS d2 FROM d), u AS (SELECT * FROM l WHERE d2 IS NOT NULL AND d1 IS NOT NULL AND d IS NOT NULL), {_orthogonal('u', 'symbol', ['d1', 'd2', 'level', 'd'])}, b AS (SELECT * FROM o2) SELECT symbol, count(*) AS n, {_t_statistic('d', 'level', 4)} AS statistic FROM b GROUP BY 1", r="statistic")
def _(spark, d):
    return M.adf(daily(spark, d), "close", 2)


@query("agg55_kpss", f"WITH c AS (SELECT symbol, ts, close - avg(close) OVER (PARTITION BY symbol) AS e FROM bars), s AS (SELECT symbol, e, sum(e) {SO_FAR} AS s FROM c) SELECT symbol, count(*) AS n, sum(s * s) / (count(*) * count(*) * (sum(e * e) / count(*))) AS statistic FROM s GROUP BY 1", r="statistic")
def _(spark, d):
    return M.kpss(daily(spark, d), "close")


@query("agg56_granger", f"WITH l AS (SELECT symbol, high AS y, {lag('high')} AS y1, {lag('high', 2)} AS y2, {lag('volume')} AS x1, {lag('volume', 2)} AS x2 FROM hourly), u AS (SELECT * FROM l WHERE y2 IS NOT NULL AND x2 IS NOT NULL), {_orthogonal('u', 'symbol', ['y1', 'y2', 'x1', 'x2', 'y'])}, s AS (SELECT symbol, sum(y * y) AS small FROM o2 GROUP BY 1), g AS (SELECT symbol, count(*) AS n, sum(y * y) AS big FROM orth GROUP BY 1) SELECT symbol, n, ((small - big) / 2) / (big / (n - 5)) AS f FROM g JOIN s USING (symbol)", use="hourly", r="f")
def _(spark, d):
    return M.granger(hourly(spark, d), "volume", "high", 2)


@query("agg57_cointegration", f"WITH f AS (SELECT symbol, regr_slope(high, low) AS b, regr_intercept(high, low) AS a FROM bars GROUP BY 1), e AS (SELECT symbol, ts, high - a - b * low AS e FROM bars JOIN f USING (symbol)), d AS (SELECT symbol, ts, e - {lag('e')} AS d, {lag('e')} AS level FROM e), l AS (SELECT symbol, d, level, {lag('d')} AS d1 FROM d), u AS (SELECT * FROM l WHERE d1 IS NOT NULL AND d IS NOT NULL), {_orthogonal('u', 'symbol', ['d1', 'level', 'd'])}, b AS (SELECT * FROM o1) SELECT symbol, count(*) AS n, {_t_statistic('d', 'level', 3)} AS statistic FROM b GROUP BY 1", r="statistic")
def _(spark, d):
    return M.engle_granger(daily(spark, d), "high", "low", 1)


# --- joins and events -------------------------------------------------------------------------------------------


@query("joi01_exact_day_join", "SELECT b.day, b.close, f.value FROM (SELECT ts::DATE + INTERVAL 29 YEAR AS day, close FROM bars WHERE symbol = '5-LOW') b JOIN (SELECT day, value FROM factors WHERE series_id = 'click') f ON b.day = f.day", use="bars factors", r="close value", t="day")
def _(spark, d):
    bars = daily(spark, d).where("symbol = '5-LOW'").select((F.col("ts") + F.expr("interval 29 years")).alias("day"), "close")
    return A.exact_join(bars, [factors(spark, d).where("series_id = 'click'").select("day", "value")])


_FEEDS = "fa AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), fb AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"


def _feeds(spark, d):
    e = read(spark, d, "events")
    one = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return one(0), one(1)


@query("joi04_agg09_feed_divergence", f"WITH {_FEEDS} SELECT symbol, count(*) AS n, avg(a - b) AS mean, avg(abs(a - b)) AS mean_abs, quantile_cont(abs(a - b), 0.5) AS p50, quantile_cont(abs(a - b), 0.95) AS p95, quantile_cont(abs(a - b), 0.99) AS p99, sum((a > b)::INT)::BIGINT AS above, sum((a < b)::INT)::BIGINT AS below FROM fa JOIN fb USING (symbol, ts) GROUP BY 1", use="", r="mean mean_abs p50 p95 p99")
def _(spark, d):
    a, b = _feeds(spark, d)
    return X.divergence(a.join(b.withColumnRenamed("close", "b"), ["symbol", "ts"]).withColumnRenamed("close", "a"))


@query("agg09_daily_divergence", f"WITH {_FEEDS} SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, avg(a - b) AS mean, avg(abs(a - b)) AS mean_abs, max(abs(a - b)) AS most FROM fa JOIN fb USING (symbol, ts) GROUP BY 1, 2", use="", r="mean mean_abs most", t="day")
def _(spark, d):
    a, b = _feeds(spark, d)
    return X.daily_divergence(a.join(b.withColumnRenamed("close", "b"), ["symbol", "ts"]).withColumnRenamed("close", "a"))


@query("joi05_forward_as_of", f"WITH {CROSS}, k AS (SELECT event_id, symbol, ts + INTERVAL 10 DAY AS target FROM ev WHERE direction IS NOT NULL) SELECT k.event_id, b.ts AS asof_ts, b.close AS asof_close FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.target <= b.ts", r="asof_close", t="asof_ts")
def _(spark, d):
    series = stored(spark, d, "daily")
    bars, e = series.rows(), W.crossovers(series).select("event_id", "symbol", (F.col("ts") + F.expr("interval 10 days")).alias("target"))
    return A.as_of(e, bars, ["close"], at="target", forward=True, width=L.YEAR).select("event_id", "asof_ts", "asof_close")


@query("joi06_backward_as_of", f"WITH {CROSS}, k AS (SELECT event_id, symbol, ts - INTERVAL 10 DAY AS target, price FROM ev WHERE direction IS NOT NULL) SELECT k.event_id, b.ts AS asof_ts, k.price / b.close - 1 AS preceding_return FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.target >= b.ts", r="preceding_return", t="asof_ts")
def _(spark, d):
    bars = daily(spark, d)
    e = W.crossovers(bars).select("event_id", "symbol", "price", (F.col("ts") - F.expr("interval 10 days")).alias("target"))
    return A.as_of(e, bars, ["close"], at="target", width=L.YEAR).select("event_id", "asof_ts", (F.col("price") / F.col("asof_close") - 1).alias("preceding_return"))


OUTCOMES = f"{CROSS}, k AS (SELECT event_id, symbol, ts, direction, price, h.h AS horizon_days, ts + to_days(h.h) AS target FROM ev, (VALUES (1), (5), (20)) AS h(h) WHERE direction IS NOT NULL), en AS (SELECT k.*, b.ts AS realized_end, b.close AS c FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.target <= b.ts), ex AS (SELECT e.event_id, e.horizon_days, max(b.high) AS hi, min(b.low) AS lo FROM en e JOIN bars b ON b.symbol = e.symbol AND b.ts > e.ts AND b.ts <= e.realized_end GROUP BY 1, 2), oc AS (SELECT event_id, symbol, ts, direction, horizon_days::INT AS horizon_days, realized_end, (c / price - 1) * CASE WHEN direction = 'bearish' THEN -1 ELSE 1 END AS ret, CASE WHEN direction = 'bearish' THEN 1 - lo / price ELSE hi / price - 1 END AS mfe, CASE WHEN direction = 'bearish' THEN 1 - hi / price ELSE lo / price - 1 END AS mae, (c / price - 1) * CASE WHEN direction = 'bearish' THEN -1 ELSE 1 END >= 0.01 AS hit FROM en LEFT JOIN ex USING (event_id, horizon_days))"


def _outcomes(spark, d):
    series = stored(spark, d, "daily")
    return L.outcomes(W.crossovers(series), series.rows(), [1, 5, 20])


@query("res01_joi07_outcomes", f"WITH {OUTCOMES} SELECT * FROM oc", r="ret mfe mae", t="ts realized_end")
def _(spark, d):
    return _outcomes(spark, d)


@query("joi08_overlap", f"WITH {OUTCOMES}, s AS (SELECT symbol, ts AS a, realized_end AS b FROM oc WHERE realized_end IS NOT NULL AND horizon_days = 20), m AS (SELECT symbol, a AS t, 1 AS k FROM s UNION ALL SELECT symbol, b, -1 FROM s), o AS (SELECT symbol, k, sum(k) OVER (PARTITION BY symbol ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM m) SELECT symbol, sum(CASE WHEN k = 1 THEN open - 1 END)::BIGINT AS pairs, max(open)::BIGINT AS concurrency FROM o GROUP BY 1")
def _(spark, d):
    own = _outcomes(spark, d).where("horizon_days = 20 and realized_end is not null")
    return A.overlap_counts(own.select("symbol", F.col("ts").alias("start"), F.col("realized_end").alias("stop")))


@query("res03_flagship_conditional_hit_rate", f"WITH {OUTCOMES}, c AS (SELECT direction, horizon_days, count(ret)::DOUBLE AS n, sum(hit::INT)::DOUBLE AS k, avg(ret) AS mean, avg(mfe) AS mean_mfe, avg(mae) AS mean_mae FROM oc WHERE ret IS NOT NULL GROUP BY 1, 2) SELECT direction, horizon_days, n::BIGINT AS n, k / n AS p_hit, {_WILSON.format(z=_Z, s='-')} AS lo, {_WILSON.format(z=_Z, s='+')} AS hi, mean, mean_mfe, mean_mae FROM c", r="p_hit lo hi mean mean_mfe mean_mae")
def flagship(spark, d):
    """Bars, crossovers, outcomes at 1, 5 and 20 days, and the hit rate of each with its interval."""
    c = _outcomes(spark, d).where("ret is not null").groupBy("direction", "horizon_days").agg(F.count("*").alias("n"), F.count_if("hit").alias("_k"), F.avg("ret").alias("mean"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))
    lo, hi = T.wilson(F.col("_k"), F.col("n"))
    return c.select("direction", "horizon_days", "n", (F.col("_k") / F.col("n")).alias("p_hit"), lo.alias("lo"), hi.alias("hi"), "mean", "mean_mfe", "mean_mae")


@query("res11_prior_rate_by_fold", f"WITH {OUTCOMES}, o5 AS (SELECT * FROM oc WHERE horizon_days = 5 AND ret IS NOT NULL), f AS (SELECT DISTINCT year(ts)::INT AS fold, date_trunc('year', ts)::TIMESTAMP AS a, date_trunc('year', ts)::TIMESTAMP + INTERVAL 1 YEAR AS b FROM o5), tr AS (SELECT fold, direction, count(*) AS n_train, avg(hit::INT) AS p FROM o5 JOIN f ON realized_end < a AND ts < a GROUP BY 1, 2), te AS (SELECT fold, direction, count(*) AS n_test, avg(hit::INT) AS observed FROM o5 JOIN f ON ts >= a AND ts < b GROUP BY 1, 2) SELECT * FROM tr JOIN te USING (fold, direction)", r="p observed")
def _(spark, d):
    own = keep(_outcomes(spark, d).where("horizon_days = 5 and ret is not null"))
    start = F.date_trunc("year", "ts")
    folds = own.select(F.year("ts").alias("fold"), start.alias("start"), (start + F.expr("interval 1 year")).alias("stop")).distinct()
    return V.prior_rate(own, folds)


@query("joi16_reaction", f"WITH i AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx, r FROM {R}), e AS (SELECT symbol, idx FROM i WHERE abs(r) > 1) SELECT e.symbol, l.lag::INT AS lag, count(*) AS n, avg(abs(i.r)) AS mean_abs FROM e, (VALUES (0), (1), (2), (3)) AS l(lag), i WHERE i.symbol = e.symbol AND i.idx = e.idx + l.lag GROUP BY 1, 2", use="rets", r="mean_abs")
def _(spark, d):
    own = S.row_index(_returns(spark, d)).select("symbol", "idx", F.col("r").alias("value"))
    return A.reaction(own.where(F.abs("value") > 1), own, 3)


@query("top05_optimal_lag", f"WITH i AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx, high AS a, volume AS b FROM hourly), l AS (SELECT x.symbol, l.lag, corr(x.a, y.b) AS c, count(*) AS n FROM i x, (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) AS l(lag), i y WHERE y.symbol = x.symbol AND y.idx = x.idx + l.lag GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, abs(lag), lag) AS rn FROM l) SELECT symbol, lag::INT AS lag, c AS corr, n FROM k WHERE rn = 1", use="hourly", r="corr")
def _(spark, d):
    return X.optimal_lag(S.row_index(hourly(spark, d), unit="day"), "high", "volume", 3)


# --- checks -----------------------------------------------------------------------------------------------------


@query("qa01_gaps", f"WITH o AS (SELECT symbol, {lag('ts')} AS a, ts AS b FROM hourly) SELECT symbol, a AS gap_start, b AS gap_end, (epoch(b)::BIGINT - epoch(a)::BIGINT) // 3600 - 1 AS missing, CASE WHEN len(list_filter(generate_series(a::DATE, b::DATE, INTERVAL 1 DAY), lambda x: isodow(x) >= 6)) > 0 THEN 'weekend' ELSE 'suspicious' END AS kind FROM o WHERE epoch(b) - epoch(a) > 7200", use="hourly", t="gap_start gap_end")
def _(spark, d):
    return Q.gaps(stored(spark, d, "hourly"), 3600)


@query("qa02_missing_bars", f"WITH o AS (SELECT symbol, {lag('ts')} AS a, ts AS b FROM hourly) SELECT symbol, unnest(generate_series(a + INTERVAL 1 HOUR, b - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM o WHERE epoch(b) - epoch(a) > 3600", use="hourly", t="ts")
def _(spark, d):
    return Q.missing_bars(stored(spark, d, "hourly"), 3600)


@query("qa03_duplicates", "WITH k AS (SELECT symbol, ts, seq AS row, first_value(seq) OVER w AS first_row, row_number() OVER w AS nth FROM ticks WINDOW w AS (PARTITION BY symbol, ts ORDER BY seq)) SELECT symbol, ts, row, first_row, nth FROM k WHERE nth > 1", use="ticks", t="ts")
def _(spark, d):
    return Q.duplicates(ticks(spark, d), "seq")


@query("qa04_price_outliers", "WITH z AS (SELECT symbol, ts, close, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_pop(close) OVER (PARTITION BY symbol) AS z FROM hourly) SELECT * FROM z WHERE abs(z) > 2", use="hourly", r="close z", t="ts")
def _(spark, d):
    return Q.z_outliers(hourly(spark, d), "close", 2.0)


@query("qa05_volume_outliers", "WITH k AS (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM hourly), q AS (SELECT symbol, max(CASE WHEN k = n // 4 THEN volume END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN volume END) AS q3 FROM k GROUP BY symbol) SELECT symbol, ts, volume FROM hourly JOIN q USING (symbol) WHERE volume < q1 - 1.5 * (q3 - q1) OR volume > q3 + 1.5 * (q3 - q1)", use="hourly", r="volume", t="ts")
def _(spark, d):
    return Q.iqr_outliers(hourly(spark, d), "volume")


@query("qa07_validation_report", f"WITH o AS (SELECT symbol, ts, volume, low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 AS ok, epoch(ts)::BIGINT - epoch({lag('ts')})::BIGINT AS dt FROM hourly), c AS (SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum((dt = 0)::INT) AS d, sum((dt > 3600)::INT) AS g, sum(CASE WHEN dt > 3600 THEN dt // 3600 - 1 ELSE 0 END) AS m, sum((NOT ok)::INT) AS i, avg(volume) AS mean_volume, count(DISTINCT ts::DATE) AS days FROM o GROUP BY 1) SELECT symbol, n, first_ts, last_ts, d::BIGINT AS duplicates, g::BIGINT AS gaps, m::BIGINT AS missing, i::BIGINT AS invalid, mean_volume, days, n / (n + m) AS coverage FROM c", use="hourly", r="mean_volume coverage", t="first_ts last_ts")
def _(spark, d):
    return Q.validation_report(stored(spark, d, "hourly"), 3600)


@query("qa10_interval", f"WITH o AS (SELECT symbol, epoch(ts)::BIGINT - epoch({lag('ts')})::BIGINT AS s FROM hourly), k AS (SELECT symbol, s, row_number() OVER (PARTITION BY symbol ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM o WHERE s IS NOT NULL) SELECT symbol, s AS seconds FROM k WHERE k = n // 2", use="hourly")
def _(spark, d):
    return Q.upper_median_interval(stored(spark, d, "hourly"))


#: A tree of hashes: more than 1,024 rows of a group make one level, and sixteen times as many each further one.
_DIG = "h AS (SELECT o_orderpriority AS k, sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS h, count(*) AS c FROM orders GROUP BY ALL), n AS (SELECT o_orderpriority AS k, count(*) AS n, len(list_filter(range(12), lambda i: count(*) > 1024 * 16 ** i)) AS l FROM orders GROUP BY 1), tree AS (SELECT k, l, h[1:l] AS p, sha256(string_agg(h || ':' || c, '' ORDER BY h)) AS d FROM h JOIN n USING (k) GROUP BY ALL UNION ALL SELECT k, l - 1, p[1:l - 1], sha256(string_agg(p[l:l] || ':' || d, '' ORDER BY p)) FROM tree WHERE l > 0 GROUP BY ALL), root AS (SELECT k, d FROM tree WHERE l = 0)"


@query("qa16_dataset_digest", f"WITH RECURSIVE {_DIG} SELECT k AS symbol, d AS digest, n FROM root JOIN n USING (k)", use="")
def _(spark, d):
    return Q.dataset_digest(read(spark, d, "orders").withColumn("symbol", F.col("o_orderpriority")), ["o_orderkey", "o_custkey", "o_orderstatus"], "symbol")


@query("qa18_audit_chain", "WITH l AS (SELECT user_id AS part, event_id AS rowid, event_type || ':' || event_id AS payload FROM events), h AS (SELECT *, sha256(payload) AS h FROM l), c AS (SELECT part, rowid, CASE WHEN rowid % 97 = 0 THEN 'forged' ELSE payload END AS payload, h, lag(h) OVER (PARTITION BY part ORDER BY rowid) AS prev FROM h) SELECT part, rowid FROM c WHERE sha256(payload) <> h", use="")
def _(spark, d):
    w = Window.partitionBy("part").orderBy("eid")
    e = read(spark, d, "events").select(F.col("user_id").alias("part"), F.col("event_id").alias("eid"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("payload"))
    e = e.withColumn("entry_hash", F.sha2("payload", 256)).withColumn("previous_entry", F.lag("entry_hash").over(w)).withColumn("rowid", F.row_number().over(w))
    log = e.withColumn("payload", F.when(F.col("eid") % 97 == 0, "forged").otherwise(F.col("payload")))
    return Q.audit_faults(log).where("fault = 'hash'").select("part", F.col("eid").alias("rowid"))


# --- folds and tests --------------------------------------------------------------------------------------------


@query("win37_chronological_split", f"WITH k AS (SELECT symbol, ts, row_number() OVER ({BY}) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM k", t="ts")
def _(spark, d):
    return V.chronological_split(daily(spark, d)).select("symbol", "ts", "split")


@query("res07_majority_baseline", f"WITH c AS (SELECT symbol, {_STATE} AS state, count(*) AS n FROM {R} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, state DESC) AS rn FROM c) SELECT symbol, state AS majority, n FROM k WHERE rn = 1", use="rets")
def _(spark, d):
    return V.majority(_states(spark, d), "state", "symbol")


@query("res15_adjusted_p_values", f"WITH t AS (SELECT symbol AS name, count(*)::DOUBLE AS n, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t FROM {R} GROUP BY 1), p AS (SELECT name, exp(-abs(t) / 10) AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p) SELECT name, p, least(1.0, p * m) AS bonferroni, least(1.0, max(p * (m - k + 1)) OVER (ORDER BY k)) AS holm, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS benjamini_hochberg FROM k", use="rets", r="p bonferroni holm benjamini_hochberg")
def _(spark, d):
    t = T.mean_tests(_returns(spark, d), "r", "symbol").select(F.col("symbol").alias("name"), F.exp(-F.abs("t") / 10).alias("p"))
    return V.adjust_p_values(t)


@query("res16_bootstrap", None, r="lo hi mean")
def _(spark, d):
    return Z.bootstrap(_returns(spark, d), "r", F.concat_ws("|", "symbol", "ts"), "symbol")


@query("res16_bootstrap_sharpe", None, r="lo hi mean")
def _(spark, d):
    return Z.bootstrap(_returns(spark, d), "r", F.concat_ws("|", "symbol", "ts"), "symbol", statistic="sharpe")


@query("res16_bootstrap_rate", None, r="lo hi mean")
def _(spark, d):
    own = _returns(spark, d).withColumn("up", (F.col("r") > 0).cast("int"))
    return Z.bootstrap(own, "up", F.concat_ws("|", "symbol", "ts"), "symbol")


@query("res17_sign_flip", None, r="p")
def _(spark, d):
    return Z.sign_flip_p(_returns(spark, d), "r", F.concat_ws("|", "symbol", "ts"), "symbol")


@query("res21_correlation_break", f"WITH o AS (SELECT symbol, ts, row_number() OVER ({BY}) AS k, count(*) OVER (PARTITION BY symbol) AS n, corr(high, volume) {SO_FAR} AS a, corr(high, volume) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM hourly), g AS (SELECT symbol, ts, abs(a - b) AS gap FROM o WHERE k >= 60 AND n - k >= 60), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gap DESC, ts) AS rn FROM g) SELECT symbol, ts, gap FROM r WHERE rn = 1", use="hourly", r="gap", t="ts")
def _(spark, d):
    return X.correlation_break(hourly(spark, d), "high", "volume", 60)


_CUSUM = f"s AS (SELECT symbol, avg(r) AS mu, 4 * stddev_pop(r) AS h FROM {R} GROUP BY 1), n AS (SELECT symbol, ts, r - mu AS v, h, row_number() OVER ({BY}) AS k FROM rets JOIN s USING (symbol) WHERE r IS NOT NULL), c AS (SELECT symbol, k, h, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS level FROM n WHERE k = 1 AND greatest(abs(v) - h / 2, 0) <= h UNION ALL SELECT n.symbol, n.k, n.h, CASE WHEN greatest(0, c.up + v - n.h / 2) > n.h THEN 0 ELSE greatest(0, c.up + v - n.h / 2) END, CASE WHEN greatest(0, c.up + v - n.h / 2) <= n.h AND greatest(0, c.down - v - n.h / 2) > n.h THEN 0 ELSE greatest(0, c.down - v - n.h / 2) END, CASE WHEN greatest(0, c.up + v - n.h / 2) > n.h THEN greatest(0, c.up + v - n.h / 2) WHEN greatest(0, c.down - v - n.h / 2) > n.h THEN -greatest(0, c.down - v - n.h / 2) ELSE 0 END FROM c JOIN n ON n.symbol = c.symbol AND n.k = c.k + 1)"


@query("res23_cusum", f"WITH RECURSIVE {_CUSUM.replace('SELECT symbol, k, h, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down', 'SELECT symbol, k, h, greatest(0, v - h / 2) AS up, greatest(0, -v - h / 2) AS down')} SELECT symbol, ts, level FROM c JOIN n USING (symbol, k) WHERE level <> 0", use="rets", r="level", t="ts")
def _(spark, d):
    return change_points(_returns(spark, d), "r")


# --- lineage and sets -------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _edges(spark, d):
    link = lambda t, a, b, x, y: read(spark, d, t).select(F.concat(F.lit(x), F.col(a)).alias("child"), F.concat(F.lit(y), F.col(b)).alias("parent"))
    return link("orders", "o_orderkey", "o_custkey", "o", "c").unionByName(link("customer", "c_custkey", "c_nationkey", "c", "n")).unionByName(link("nation", "n_nationkey", "n_regionkey", "n", "r"))


@query("gra02_descendants", f"WITH RECURSIVE {_EDGES}, s AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT s.start, e.child, s.depth + 1 FROM s JOIN e ON e.parent = s.node) SELECT start, depth::INT AS depth, count(*) AS n FROM s WHERE depth > 0 GROUP BY 1, 2", use="")
def _(spark, d):
    starts = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return G.closure(_edges(spark, d), starts).groupBy("start", F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


@query("gra08_degrees", f"WITH {_EDGES}, a AS (SELECT parent AS node, count(*) AS children FROM e GROUP BY 1), b AS (SELECT child AS node, count(*) AS parents FROM e GROUP BY 1) SELECT node, coalesce(children, 0) AS children, coalesce(parents, 0) AS parents FROM a FULL JOIN b USING (node)", use="")
def _(spark, d):
    return G.degrees(_edges(spark, d))


@query("gra06_lineage_hash", f"WITH {_EDGES}, p AS (SELECT child AS node, string_agg(DISTINCT parent, ',' ORDER BY parent) AS p FROM e GROUP BY 1) SELECT node, sha256(node || '|' || p) AS lineage FROM p", use="")
def _(spark, d):
    e = _edges(spark, d)
    return G.lineage_hash(e.select(F.col("child").alias("node")).distinct(), e)


@query("gra06_content_hash", "SELECT 'o' || o_orderkey AS node, sha256('{' || '\"custkey\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"type\":\"order\"}') AS content FROM orders", use="")
def _(spark, d):
    nodes = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node"), F.lit("order").alias("type"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"))
    return G.content_hash(nodes, ["type", "priority", "custkey"])


@query("joi11_orphans", f"WITH {_EDGES}, k AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT 'o' || o_orderkey FROM orders) SELECT parent, child, 'parent' AS missing FROM e WHERE child LIKE 'o%' AND parent NOT IN (SELECT node FROM k)", use="")
def _(spark, d):
    nodes = read(spark, d, "customer").where("c_custkey % 50 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node")).unionByName(read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node")))
    return A.orphans(_edges(spark, d).where("child like 'o%'"), nodes)


@query("set01_common_days", "SELECT day FROM factors WHERE series_id = 'click' INTERSECT SELECT day FROM factors WHERE series_id = 'view' INTERSECT SELECT day FROM factors WHERE series_id = 'error'", use="factors", t="day")
def _(spark, d):
    f = factors(spark, d)
    one = lambda s: f.where(F.col("series_id") == s).select("day")
    return one("click").intersect(one("view")).intersect(one("error"))


@query("set02_store_difference", f"WITH {_FEEDS} SELECT 'a' AS side, symbol, ts FROM (SELECT symbol, ts FROM fa EXCEPT SELECT symbol, ts FROM fb) UNION ALL SELECT 'b', symbol, ts FROM (SELECT symbol, ts FROM fb EXCEPT SELECT symbol, ts FROM fa)", use="", t="ts")
def _(spark, d):
    a, b = (x.select("symbol", "ts") for x in _feeds(spark, d))
    return a.exceptAll(b).select(F.lit("a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("b").alias("side"), "*"))
