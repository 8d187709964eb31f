"""Queries whose rules have fixed cut-offs or words, and those that split every row of a series into parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as C
from tidemark.operators import asof as A
from tidemark.operators import folds as V
from tidemark.operators import relations as X
from tidemark.operators import retrieval as I
from tidemark.operators import scan as S
from tidemark.operators import stats as T
from tidemark.operators import study as Y
from tidemark.operators import windows as W
from tidemark.plans.analysis_queries import _FEEDS, _WIDE, R, _feeds, _returns, _wide
from tidemark.plans.registry import BY, daily, full, hourly, lag, over, p_value, query, read, roll, stored, ticks, with_returns
from tidemark.plans.window_queries import SO_FAR
from tidemark.streaming import jobs as J

# --- words and rates --------------------------------------------------------------------------------------------

_POSITIVE, _NEGATIVE = (", ".join(f"'{w}'" for w in words) for words in (C.POSITIVE, C.NEGATIVE))


@query("fun02_sentiment", f"WITH w AS (SELECT lang, source, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s%$.-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM documents), c AS (SELECT lang, source, len(list_intersect(w, [{_POSITIVE}])) AS p, len(list_intersect(w, [{_NEGATIVE}])) AS n FROM w) SELECT lang, source, count(*) AS docs, sum((p > 0 OR n > 0)::INT)::BIGINT AS scored, avg(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END) AS mean FROM c GROUP BY lang, source", use="", r="mean")
def _(spark, d):
    own = read(spark, d, "documents").select("lang", "source", C.sentiment(F.col("text")).alias("s"), (F.size(F.array_intersect(F.split(C.news_text(F.col("text")), " "), F.array(*map(F.lit, C.POSITIVE + C.NEGATIVE)))) > 0).alias("hit"))
    return own.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.count_if("hit").alias("scored"), F.avg(F.coalesce("s", F.lit(0.0))).alias("mean"))


_SESSION = "CASE WHEN hour(ts) < 8 THEN 'Asian' WHEN hour(ts) < 16 THEN 'European' WHEN hour(ts) < 21 THEN 'Overlap' ELSE 'US' END"


@query("fun03_calendar", f"SELECT event_id, {_SESSION} AS session, (isodow(ts) - 1)::INT AS weekday, to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS aligned FROM events", use="", t="aligned")
def _(spark, d):
    return read(spark, d, "events").select("event_id", X.session("ts").alias("session"), F.weekday("ts").alias("weekday"), C.align(F.col("ts"), 900).alias("aligned"))


@query("agg13_sessions", f"SELECT {_SESSION} AS session, count(*) AS n, avg(close - open) AS mean, stddev_samp(close - open) AS sd, avg((close > open)::INT) AS positive, avg((close < open)::INT) AS negative, avg((close = open)::INT) AS flat FROM hourly GROUP BY 1", use="hourly", r="mean sd positive negative flat")
def _(spark, d):
    return X.sessions(hourly(spark, d))


_REGIME = "f IS NULL OR s IS NULL OR f = 0 OR s = 0 OR close = 0"


@query("fun09_market_state", f"WITH b AS (SELECT *, {lag('close')} AS pc FROM bars), t AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM b), o AS (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS f, {roll('avg', 'close', 50)} AS s, {roll('avg', 'tr', 14)} AS atr FROM t) SELECT symbol, ts, CASE WHEN {_REGIME} THEN 'Unknown' WHEN abs(f - s) / s > 0.01 THEN CASE WHEN f > s THEN 'Trending_Up' ELSE 'Trending_Down' END ELSE 'Ranging' END AS regime, CASE WHEN {_REGIME} THEN 'Unknown' WHEN atr / close * 100 > 2 THEN 'High' WHEN atr / close * 100 > 1 THEN 'Medium' ELSE 'Low' END AS volatility FROM o", t="ts")
def _(spark, d):
    own = daily(spark, d).select("symbol", "ts", "close", W.sma("close", 20).alias("f"), W.sma("close", 50).alias("s"), W.true_range().alias("tr"))
    own = own.select("*", W.sma("tr", 14).alias("atr"))
    f, s, c = F.col("f"), F.col("s"), F.col("close")
    return own.select("symbol", "ts", C.regime(f, s, c).alias("regime"), C.volatility_state(f, s, F.col("atr"), c).alias("volatility"))


@query("fun11_policy_action", f"WITH o AS (SELECT symbol, ts, round(close) - {lag('round(close)')} AS s FROM bars) SELECT symbol, ts, CASE WHEN s > 0 THEN 'hike' WHEN s < 0 THEN 'cut' WHEN s = 0 THEN 'hold' END AS action FROM o", t="ts")
def _(spark, d):
    own = daily(spark, d).withColumn("rate", F.round("close"))
    return own.select("symbol", "ts", C.policy_action(W.previous("rate"), F.col("rate")).alias("action"))


@query("fun12_costs", "SELECT symbol, sum(price * 0.001) AS pct, sum(0.5::DOUBLE) AS fixed, sum(0.25::DOUBLE) AS bare, sum(0.125::DOUBLE) AS empty FROM ticks GROUP BY 1", use="ticks", r="pct fixed bare empty", digits=3)
def _(spark, d):
    p = F.col("price")
    specs = {"pct": C.cost("PCT:0.001", p), "fixed": C.cost("fixed:0.5", p), "bare": C.cost("0.25", p), "empty": C.cost("", p, 0.125)}
    return ticks(spark, d).groupBy("symbol").agg(*[F.sum(c).alias(n) for n, c in specs.items()])


@query("agg23_strength", f"WITH w AS ({_WIDE}), c AS (SELECT corr(c_click, c_view) AS r, count(*) FILTER (WHERE c_click IS NOT NULL AND c_view IS NOT NULL) AS n FROM w) SELECT r AS corr, n, CASE WHEN r > 0.05 THEN 'positive' WHEN r < -0.05 THEN 'negative' ELSE 'neutral' END AS type, CASE WHEN abs(r) >= 0.8 THEN 'very_strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength FROM c", use="factors", r="corr")
def _(spark, d):
    both = F.col("c_click").isNotNull() & F.col("c_view").isNotNull()
    own = _wide(spark, d).agg(W.corr("c_click", "c_view").alias("corr"), F.count_if(both).alias("n"))
    return own.select("corr", "n", T.relation_type(F.col("corr")).alias("type"), T.strength(F.col("corr")).alias("strength"))


_T = "abs(r) * sqrt((n - 2) / (1 - r * r))"


@query("agg23_p_value", f"WITH c AS (SELECT symbol, corr(high, volume) AS r, count(*) AS n FROM hourly GROUP BY symbol), t AS (SELECT *, {_T} AS t FROM c) SELECT symbol, r AS corr, n, {p_value('t', '(n - 2)')} AS p FROM t", use="hourly", r="corr p")
def _(spark, d):
    own = hourly(spark, d).groupBy("symbol").agg(W.corr("high", "volume").alias("corr"), F.count("*").alias("n"))
    return own.select("symbol", "corr", "n", T.correlation_p(F.col("corr"), F.col("n")).alias("p"))


@query("agg23_small_samples", f"WITH c AS (SELECT symbol, date_trunc('day', ts) AS day, CASE WHEN var_pop(high) > 0 AND var_pop(volume) > 0 THEN corr(high, volume) END AS r, count(*) AS n FROM hourly GROUP BY 1, 2), t AS (SELECT *, CASE WHEN n >= 3 AND abs(r) < 1 - 1e-9 THEN {_T} END AS t FROM c WHERE r IS NULL OR abs(r) < 1 - 1e-9) SELECT symbol, day, r AS corr, n, CASE WHEN t IS NOT NULL THEN {p_value('t', '(n - 2)')} END AS p FROM t", use="hourly", r="corr p", t="day")
def _(spark, d):
    """Correlations of one day's hours: 3 to 24 pairs, by Student's law."""
    own = hourly(spark, d).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(W.corr("high", "volume").alias("corr"), F.count("*").alias("n"))
    own = own.where(F.col("corr").isNull() | (F.abs("corr") < 1 - 1e-9))
    return own.select("symbol", "day", "corr", "n", T.correlation_p(F.col("corr"), F.col("n")).alias("p"))


_TENORS = [0.25, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 25.0, 30.0]
_CURVE = f"c AS (SELECT date_trunc('month', o_orderdate) AS day, ({_TENORS})[o_orderkey % 10 + 1]::DOUBLE AS tenor, avg(o_totalprice / 997) AS y FROM orders GROUP BY 1, 2), g AS (SELECT day, count(*) AS n, list(y ORDER BY tenor) AS ys, covar_pop(tenor, y) AS xy, var_pop(tenor) AS xx, max(y) FILTER (WHERE tenor = 10) AS y10, max(y) FILTER (WHERE tenor = 2) AS y2, max(y) FILTER (WHERE tenor = 30) AS y30, max(y) FILTER (WHERE tenor = 0.25) AS y3m FROM c GROUP BY 1)"


@query("agg45_yield_curve", f"WITH {_CURVE} SELECT day, CASE WHEN n < 3 THEN 0 ELSE ys[n] END AS level, CASE WHEN n < 3 THEN 0 ELSE xy / xx END AS slope, CASE WHEN n < 3 THEN 0 ELSE ys[1] + ys[n] - 2 * ys[n // 2 + 1] END AS curvature, y10 - y2 AS spread_10y_2y, y30 - y10 AS spread_30y_10y, y10 - y3m AS spread_10y_3m FROM g", use="", r="level slope curvature spread_10y_2y spread_30y_10y spread_10y_3m", t="day")
def _(spark, d):
    tenor = F.element_at(F.array(*map(F.lit, _TENORS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    o = read(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("day"), tenor.alias("tenor")).agg(F.avg(F.col("o_totalprice") / 997).alias("yield"))
    return Y.yield_curve(o)


_SURPRISE = "CASE WHEN forecast = 0 THEN 0 ELSE (actual - forecast) / abs(forecast) END"


@query("agg47_surprises", f"WITH p AS (SELECT symbol, close AS actual, CASE WHEN dayofmonth(ts) = 1 THEN 0 ELSE {lag('close')} END AS forecast FROM bars), s AS (SELECT symbol, {_SURPRISE} AS s FROM p WHERE forecast IS NOT NULL) SELECT symbol, count(s) AS n, avg(s) AS mean, avg(abs(s)) AS mean_abs, count(*) FILTER (WHERE s > 0.01) AS above, count(*) FILTER (WHERE s < -0.01) AS below FROM s GROUP BY 1", r="mean mean_abs")
def _(spark, d):
    own = daily(spark, d).select("symbol", F.col("close").alias("actual"), F.when(F.dayofmonth("ts") == 1, 0.0).otherwise(W.previous("close")).alias("forecast"))
    return X.surprises(own, "symbol")


@query("agg50_source_ledger", "WITH o AS (SELECT event_type AS source, ts::DATE AS day, CASE WHEN event_id % 7 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts FROM events), c AS (SELECT count(*) AS common FROM (SELECT day FROM o GROUP BY day HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM o))), s AS (SELECT source, count(*) AS n, count(DISTINCT day) AS days, count(*) - count(DISTINCT ts) AS duplicates FROM o GROUP BY 1) SELECT source, n, days, duplicates, common, days - common AS besides, greatest(greatest(common - 20, 0) - 5, 0) AS usable FROM s, c", use="")
def _(spark, d):
    ts = F.when(F.col("event_id") % 7 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    return Y.ledger(read(spark, d, "events").select(F.col("event_type").alias("source"), ts.alias("ts")), 20, 5)


_ITEMS = "i AS (SELECT o_custkey AS context, o_orderpriority AS source, CASE o_orderstatus WHEN 'O' THEN 'Bullish' WHEN 'F' THEN 'Bearish' ELSE 'Neutral' END AS direction, o_totalprice / 997000 AS strength, (o_orderkey % 3 + 1) / 3 AS weight, (o_orderkey % 11) / 10 AS confidence, CASE o_orderpriority WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 0.3 ELSE 0.2 END AS sw FROM orders)"


@query("agg61_evidence_scores", f"WITH {_ITEMS}, s AS (SELECT context, source, sum(CASE WHEN direction = 'Bullish' THEN strength * weight * sw ELSE 0 END) AS u, sum(CASE WHEN direction = 'Bearish' THEN strength * weight * sw ELSE 0 END) AS d, sum(CASE WHEN direction = 'Neutral' THEN strength * weight * sw ELSE 0 END) AS n, max(confidence) AS c FROM i GROUP BY 1, 2), t AS (SELECT context, sum(u) AS u, sum(d) AS d, sum(n) AS n, avg(c) AS confidence FROM s GROUP BY 1) SELECT context, u / greatest(u, d, n, 0.001) AS bullish, d / greatest(u, d, n, 0.001) AS bearish, n / greatest(u, d, n, 0.001) AS neutral, greatest(-1, least(1, u - d)) AS score, confidence FROM t", use="", r="bullish bearish neutral score confidence")
def _(spark, d):
    key = F.col("o_orderkey")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("context"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "O", "Bullish").when(F.col("o_orderstatus") == "F", "Bearish").otherwise("Neutral").alias("direction"), (F.col("o_totalprice") / 997000).alias("strength"), ((key % 3 + 1) / 3).alias("weight"), ((key % 11) / 10).alias("confidence"))
    return Y.evidence(o, spark.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.3)], "source string, source_weight double"))


@query("agg63_account_limits", "WITH b AS (SELECT user_id AS account, event_id AS trade, ts::DATE AS day, 1000 + sum(value - 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance, value / 10 AS risk, value / 10 * (event_id % 4) AS reward FROM events), m AS (SELECT *, (1000 - min(balance) OVER (PARTITION BY account, day)) / 1000 * 100 AS daily_dd, (1000 - balance) / 1000 * 100 AS total_dd, risk / balance * 100 AS risk_pct, CASE WHEN risk > 0 THEN reward / risk ELSE 0 END AS rr FROM b) SELECT account, trade, daily_dd, total_dd, risk_pct, rr, daily_dd <= 5 AS daily_ok, total_dd <= 10 AS total_ok, risk_pct <= 0.11 AS risk_ok, rr >= 2 AS rr_ok, daily_dd <= 5 AND total_dd <= 10 AND risk_pct <= 0.11 AND rr >= 2 AS valid FROM m", use="", r="daily_dd total_dd risk_pct rr")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    risk = F.col("value") / 10
    b = read(spark, d, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("trade"), "ts", F.lit(1000.0).alias("initial"), (1000 + F.sum(F.col("value") - 10).over(w)).alias("balance"), risk.alias("risk_amount"), (risk * (F.col("event_id") % 4)).alias("reward_amount"))
    return Y.account_limits(b, 5.0, 10.0, 0.11)


# --- windows ----------------------------------------------------------------------------------------------------

_MOVES = f"max(high) {over(30)} > min(high) {over(30)} AND max(volume) {over(30)} > min(volume) {over(30)}"


@query("win06_rolling_relation", f"SELECT symbol, ts, CASE WHEN count(*) {over(30)} = 30 AND {_MOVES} THEN corr(high, volume) {over(30)} END AS corr, CASE WHEN count(*) {over(30)} = 30 THEN covar_samp(high, volume) {over(30)} END AS covar FROM hourly", use="hourly", r="corr covar", t="ts", digits=4)
def _(spark, d):
    return W.rolling_relation(stored(spark, d, "hourly"), "high", "volume", 30)


def _sign(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 1.0 WHEN {a} < {b} THEN -1.0 WHEN {a} IS NOT NULL THEN 0.0 END::DOUBLE"


@query("win22_trend_state", f"WITH o AS (SELECT symbol, ts, {roll('avg', 'close', 20)} AS f, {roll('avg', 'close', 50)} AS s, close - {lag('close', 14)} AS m, {roll('stddev_pop', 'l', 20)} AS a, {roll('stddev_pop', 'l', 60)} AS b FROM (SELECT *, ln(close / {lag('close')}) AS l FROM bars)) SELECT symbol, ts, CASE WHEN s IS NOT NULL THEN {_sign('f', 's')} END AS trend_state, {_sign('m', '0')} AS momentum_regime, CASE WHEN b IS NOT NULL THEN {_sign('a', 'b')} END AS vol_regime FROM o", t="ts")
def _(spark, d):
    return W.trend_state(stored(spark, d, "daily"))


_SCORE = f"p AS (SELECT symbol, ts, (close - min(close) {SO_FAR}) / nullif(max(close) {SO_FAR} - min(close) {SO_FAR}, 0) AS p FROM bars)"


@query("win29_thresholds", f"WITH {_SCORE}, o AS (SELECT symbol, ts, p, {full(f'quantile_cont(p, 0.7) {over(60)}', 'p', 60)} AS hi, {full(f'quantile_cont(p, 0.3) {over(60)}', 'p', 60)} AS lo FROM p) SELECT symbol, ts, CASE WHEN p > hi THEN 1 WHEN p < lo THEN -1 ELSE 0 END AS signal, CASE WHEN p > hi THEN least(1, greatest(0, (p - hi) / (1 - hi + 1e-9))) WHEN p < lo THEN least(1, greatest(0, (lo - p) / (lo + 1e-9))) ELSE 0.5 END AS confidence, p AS prediction FROM o WHERE p IS NOT NULL", r="confidence prediction", t="ts")
def _(spark, d):
    w = W.series().rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.min("close").over(w), F.max("close").over(w)
    return W.thresholds(daily(spark, d).select("symbol", "ts", F.try_divide(F.col("close") - lo, hi - lo).alias("p")), "p")


@query("win40_position_size", f"WITH q AS (SELECT symbol, ts, r, {roll('stddev_samp', 'r', 20)} * sqrt(252) AS v, 1 - close / max(close) {SO_FAR} AS dd FROM rets), m AS (SELECT *, max(dd) {SO_FAR} AS worst FROM q) SELECT symbol, ts, CASE WHEN v <= 1e-9 OR r = 0 THEN 0 ELSE CASE WHEN v IS NOT NULL THEN least(0.15 / v, 3) END END * CASE WHEN worst >= 0.99 THEN 0 WHEN worst >= 0.792 THEN greatest(0, 1 - (worst - 0.792) / 0.198) ELSE 1 END AS size FROM m WHERE r IS NOT NULL AND v IS NOT NULL", use="rets", r="size", t="ts")
def _(spark, d):
    own = with_returns(daily(spark, d)).select("symbol", "ts", F.col("r").alias("prediction"), (W.rolling(F.stddev_samp, "r", 20) * 252**0.5).alias("volatility"), F.col("close").alias("equity"))
    return Y.position_size(own, 0.15, 0.99, 3.0).where("size is not null")


# --- joins, breaks and folds over whole series ------------------------------------------------------------------


@query("joi03_compare_feeds", f"WITH {_FEEDS}, c AS (SELECT symbol, count(*) AS n, sum((a IS NULL)::INT)::BIGINT AS missing_a, sum((b IS NULL)::INT)::BIGINT AS missing_b, corr(a, b) AS corr, avg(CASE WHEN a <> 0 THEN abs(a - b) / abs(a) END) AS mape, max(abs(a - b)) AS max_gap FROM fa FULL JOIN fb USING (symbol, ts) GROUP BY 1) SELECT *, CASE WHEN corr > 0.99 AND mape < 0.01 THEN 'EXCELLENT' WHEN corr > 0.95 AND mape < 0.05 THEN 'GOOD' ELSE 'POOR' END AS grade FROM c", use="", r="corr mape max_gap")
def _(spark, d):
    a, b = _feeds(spark, d)
    return A.quality_grade(A.compare_feeds(a, b))


_SPLIT = f"o AS (SELECT symbol, ts, row_number() OVER ({BY}) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n, close - avg(close) OVER (PARTITION BY symbol) AS v FROM bars), c AS (SELECT symbol, ts, k, n, sum(v) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, sum(v * v) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, sum(v) OVER (PARTITION BY symbol) AS st, sum(v * v) OVER (PARTITION BY symbol) AS qt FROM o), m AS (SELECT *, s / k AS m1, (st - s) / (n - k) AS m2 FROM c WHERE k >= n // 4 AND k < 3 * n // 4 AND k > 0), g AS (SELECT symbol, k, ts, CASE WHEN p > 0 THEN abs(m1 - m2) / sqrt(p * (1 / k + 1 / (n - k))) ELSE 0 END AS statistic FROM (SELECT *, (q / k - m1 * m1 + (qt - q) / (n - k) - m2 * m2) / 2 AS p FROM m))"


@query("res22_mean_shift", f"WITH {_SPLIT}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY statistic DESC, k) AS rn FROM g) SELECT symbol, k AS idx, ts, statistic, statistic > 2 AS has_break FROM b WHERE rn = 1", r="statistic", t="ts")
def _(spark, d):
    return X.mean_shift(daily(spark, d), "close")


@query("joi15_nearest_rows", f"WITH k AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS id, close, volume FROM bars), p AS (SELECT q.symbol, q.id AS test_id, t.id, sqrt((t.close - q.close) ** 2 + (t.volume - q.volume) ** 2) AS distance FROM k q JOIN k t ON q.symbol = t.symbol AND q.id <> t.id WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, test_id ORDER BY distance, id) AS rank FROM p) SELECT symbol, test_id, id, distance, rank FROM r WHERE rank <= 5", r="distance")
def _(spark, d):
    own = S.row_index(daily(spark, d)).select("symbol", F.col("idx").alias("id"), "close", "volume")
    return I.nearest_rows(own, own.where("id % 100 = 0"), ["close", "volume"], "symbol", 5).select("symbol", "test_id", "id", "distance", "rank")


@query("res05_purged_folds", f"WITH i AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT symbol, idx, n, k::INT AS fold, k * n // 5 AS a, (k + 1) * n // 5 AS b FROM i, range(5) AS t(k)) SELECT symbol, fold, CASE WHEN idx >= a AND idx < b THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM f WHERE (idx >= a AND idx < b) OR idx < greatest(a - 10, 0) OR idx >= least(b + 15, n) GROUP BY 1, 2, 3")
def _(spark, d):
    rows = S.row_index(daily(spark, d))
    return V.assign_purged(rows, V.purged_folds(rows, 5, 10, 5)).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"))


@query("res08_binned_classifier", f"WITH i AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS m, r, CASE WHEN lead(r) OVER ({BY}) > 0 THEN 1 ELSE 0 END AS y FROM {R}), t AS (SELECT * FROM i WHERE idx < 4 * m // 5), v AS (SELECT * FROM i WHERE idx >= 4 * m // 5), e AS (SELECT symbol, min(r) AS lo, max(r) AS hi FROM t GROUP BY 1), g AS (SELECT symbol, least(4, greatest(0, floor((r - lo) / (hi - lo) * 5)))::INT AS bin, avg(y) AS p FROM t JOIN e USING (symbol) GROUP BY 1, 2) SELECT v.symbol, count(*) AS n, avg((p - y) ** 2) AS brier FROM v JOIN e USING (symbol) JOIN g ON g.symbol = v.symbol AND g.bin = least(4, greatest(0, floor((r - lo) / (hi - lo) * 5)))::INT GROUP BY 1", use="rets", r="brier")
def _(spark, d):
    own = S.row_index(_returns(spark, d)).withColumn("y", F.when(F.lead("r").over(W.series()) > 0, 1).otherwise(0))
    sized = own.join(F.broadcast(own.groupBy("symbol").agg(F.count("*").alias("m"))), "symbol").withColumn("cut", F.floor(4 * F.col("m") / 5))
    scored = Y.binned_probabilities(sized.where("idx < cut"), sized.where("idx >= cut"), "r", "y", 5)
    return scored.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


# --- streams ----------------------------------------------------------------------------------------------------


@query("str04_unique", "SELECT DISTINCT user_id, event_type FROM events", use="")
def _(spark, d):
    e = J.stream_table(spark, f"{d}/events.parquet").select("user_id", "event_type", "ts")
    return J.drain(J.unique(e, ["user_id", "event_type"], "3650 days"), "append").select("user_id", "event_type")


_WALK = "w AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, sum(value - 10) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, sign(value - 10) AS s FROM events), d AS (SELECT *, total - greatest(0, max(total) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING)) AS dd, n - row_number() OVER (PARTITION BY symbol, s ORDER BY n) AS run FROM w), k AS (SELECT symbol, s, run, count(*) AS len, max(n) AS last FROM d GROUP BY 1, 2, 3)"
_ALARM = "o AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, value - 10 AS v FROM events), c AS (SELECT symbol, n, CASE WHEN greatest(0, v) > 100 THEN 0 ELSE greatest(0, v) END AS up, (greatest(0, v) > 100)::INT AS alarms FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.n, CASE WHEN greatest(0, c.up + v) > 100 THEN 0 ELSE greatest(0, c.up + v) END, c.alarms + (greatest(0, c.up + v) > 100)::INT FROM c JOIN o ON o.symbol = c.symbol AND o.n = c.n + 1)"


@query("str06_monitor", f"WITH RECURSIVE {_ALARM}, {_WALK}, a AS (SELECT symbol, max(alarms) AS alarms FROM c GROUP BY 1), t AS (SELECT symbol, max(n) AS n, arg_max(total, n) AS total, min(least(dd, 0)) AS drawdown FROM d GROUP BY 1) SELECT t.symbol, t.n, t.total, t.drawdown, (k.len * k.s)::INT AS streak, a.alarms::INT AS alarms FROM t JOIN a USING (symbol) JOIN k ON k.symbol = t.symbol AND k.last = t.n", use="", r="total drawdown", digits=2)
def _(spark, d):
    rows = J.stream_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") - 10).alias("value"))
    out = J.drain(J.monitor(rows, 100.0), "update")
    return out.groupBy("symbol").agg(F.max("n").alias("n"), *[F.max_by(c, "n").alias(c) for c in ("total", "drawdown", "streak", "alarms")])
