"""Queries: sources and sinks, scalar functions, retrieval, remaining joins and aggregates, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as C
from tidemark.operators import asof as A
from tidemark.operators import bars as B
from tidemark.operators import folds as V
from tidemark.operators import labels as L
from tidemark.operators import lineage as G
from tidemark.operators import quality as Q
from tidemark.operators import regress as M
from tidemark.operators import relations as X
from tidemark.operators import retrieval as I
from tidemark.operators import risk as K
from tidemark.operators import scan as S
from tidemark.operators import study as Y
from tidemark.operators import windows as W
from tidemark.plans.analysis_queries import _STATE, OUTCOMES, R, _edges, _outcomes, _returns, _states
from tidemark.plans.registry import BY, daily, factors, full, hourly, lag, over, query, read, roll, stored, ticks, with_returns
from tidemark.plans.window_queries import CROSS, SO_FAR
from tidemark.sources import csv as csv_source
from tidemark.sources import tables
from tidemark.sources.scratch import scratch
from tidemark.streaming import jobs as J

# --- sources and sinks ------------------------------------------------------------------------------------------


@query("src01_csv_bars", "SELECT symbol, ts, open, high, low, close, volume FROM hourly", use="hourly", r="open high low close volume", t="ts")
def _(spark, d):
    path = scratch(spark)
    h = hourly(spark, d)
    h.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"), F.col("volume").alias("V"), F.col("symbol").alias("Ticker")).write.option("header", True).csv(path)
    return csv_source.load_bars(spark, path, timeframe="1h").drop("timeframe")


@query("src02_terminal_csv_zone", "SELECT 'click' AS symbol, ts - INTERVAL 2 HOUR AS ts, open, high, low, close, volume FROM hourly WHERE symbol = 'click'", use="hourly", r="open high low close volume", t="ts")
def _(spark, d):
    path = scratch(spark)
    h = hourly(spark, d).where("symbol = 'click'")
    h.select(F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"), F.col("open").alias("<OPEN>"), F.col("high").alias("<HIGH>"), F.col("low").alias("<LOW>"), F.col("close").alias("<CLOSE>"), F.col("volume").alias("<TICKVOL>")).write.option("header", True).option("sep", "\t").csv(path)
    return csv_source.load_auto(spark, path, "click", "1h", zone="+02:00").drop("timeframe")


@query("src03_chart_csv_unique", "SELECT symbol, ts, min(struct_pack(o := open, h := high, l := low, c := close)).c AS close FROM (SELECT 'x' AS symbol, ts, open, high, low, close FROM hourly) GROUP BY symbol, ts", use="hourly", r="close", t="ts")
def _(spark, d):
    path = scratch(spark)
    hourly(spark, d).select(F.unix_timestamp("ts").alias("time"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return csv_source.load_chart_bars(spark, path, "x", "1h").select("symbol", "ts", "close")


@query("src05_ticks_csv", "SELECT symbol, ts, price FROM ticks", use="ticks", r="price", t="ts")
def _(spark, d):
    path = scratch(spark)
    t = ticks(spark, d)
    t.select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "price", "volume", F.lit("buy").alias("side"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask")).write.option("header", True).csv(path)
    return csv_source.load_ticks(spark, path).select("symbol", "ts", "price")


@query("src08_macro_csv", "SELECT day, value FROM factors WHERE series_id = 'view'", use="factors", r="value", t="day")
def _(spark, d):
    path = scratch(spark)
    f = factors(spark, d).where("series_id = 'view'").select(F.date_format("day", "yyyy-MM-dd").alias("DATE"), F.col("value").cast("string").alias("VIEW"))
    gap = f.limit(1).select(F.lit("2030-01-01").alias("DATE"), F.lit(".").alias("VIEW"))
    f.unionByName(gap).write.option("header", True).csv(path)
    return csv_source.load_macro(spark, path, "VIEW")


@query("src06_src12_parquet_catalog", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY 1", t="first_ts last_ts")
def _(spark, d):
    path = scratch(spark)
    tables.save(daily(spark, d), path)
    return tables.catalog(tables.load_parquet(spark, path)).drop("digest")


@query("prj08_datasets_by_span", "WITH c AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, first_ts, last_ts, n FROM c WHERE first_ts <= '1995-01-02' AND last_ts >= '1995-01-01'", t="first_ts last_ts")
def _(spark, d):
    return tables.overlapping(tables.catalog(daily(spark, d)), "1995-01-01", "1995-01-02").drop("digest")


@query("prj08_datasets_by_timeframe_and_tag", "WITH c AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, 'D1' AS timeframe, first_ts, last_ts, n FROM c WHERE first_ts <= '2001-01-01' AND last_ts >= '1999-01-01' AND symbol IN ('1-URGENT', '2-HIGH')", t="first_ts last_ts")
def _(spark, d):
    tags = F.when(F.col("symbol") < "3", F.array(F.lit("urgent"), F.lit("daily"))).otherwise(F.array(F.lit("daily")))
    rows = tables.catalog(daily(spark, d)).withColumns({"timeframe": F.lit("D1"), "tags": tags})
    return tables.overlapping(rows, "1999-01-01", "2001-01-01", "D1", "urgent").select("symbol", "timeframe", "first_ts", "last_ts", "n")


@query("qa17_integrity", "SELECT DISTINCT symbol FROM bars WHERE symbol = '2-HIGH'")
def _(spark, d):
    bars = daily(spark, d)
    touched = bars.withColumn("close", F.when((F.col("symbol") == "2-HIGH") & (F.dayofmonth("ts") == 1), 0.0).otherwise(F.col("close")))
    return tables.verify(tables.catalog(bars), touched).select("symbol")


@query("qa14_signal_faults", f"WITH s AS (SELECT symbol, ts, ts + INTERVAL 1 DAY * (CASE WHEN dayofmonth(ts) = 13 THEN -1 ELSE 1 END) AS v, CASE WHEN dayofmonth(ts) = 20 THEN 1.5 ELSE 0.5 END AS c FROM bars) SELECT symbol, ts, 'early' AS fault FROM s WHERE v < ts UNION ALL SELECT symbol, ts, 'confidence' FROM s WHERE c > 1", t="ts")
def _(spark, d):
    day = F.dayofmonth("ts")
    s = daily(spark, d).select("symbol", "ts", (F.col("ts") + F.when(day == 13, F.expr("interval -1 day")).otherwise(F.expr("interval 1 day"))).alias("valid_from"), F.lit("BUY").alias("signal"), F.when(day == 20, 1.5).otherwise(0.5).alias("confidence"))
    return tables.signal_faults(s)


# --- functions --------------------------------------------------------------------------------------------------


@query("fun01_tokens", "SELECT p_partkey, len(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))) AS n FROM part", use="")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.size(C.tokens(F.col("p_name"))).cast("long").alias("n"))


@query("fun07_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", use="")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.get(F.map_values(F.from_json("props", "map<string,long>")), 0).alias("k"))


@query("fun08_record_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS hash FROM nation", use="")
def _(spark, d):
    return read(spark, d, "nation").select("n_nationkey", C.record_hash("n_nationkey", "n_name").alias("hash"))


@query("fun10_real_yield", "SELECT l_orderkey, l_linenumber, l_discount - l_tax AS plain, (1 + l_discount) / (1 + l_tax) - 1 AS fisher FROM lineitem", use="", r="plain fisher")
def _(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.real_yield(a, b).alias("plain"), C.real_yield(a, b, fisher=True).alias("fisher"))


@query("prj03_quotes", "SELECT l_orderkey, l_linenumber, (b + a) / 2 AS mid, a - b AS spread, (a - b) / ((a + b) / 2) * 10000 AS spread_bps, p * l_quantity AS notional FROM (SELECT *, l_extendedprice / 0.997 / l_quantity AS p, l_extendedprice / 0.997 / l_quantity * (1 - l_discount / 10) AS b, l_extendedprice / 0.997 / l_quantity * (1 + l_tax / 10) AS a FROM lineitem)", use="", r="mid spread spread_bps notional", digits=3)
def _(spark, d):
    p = F.col("l_extendedprice") / 0.997 / F.col("l_quantity")
    q = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", p.alias("p"), (p * (1 - F.col("l_discount") / 10)).alias("bid"), (p * (1 + F.col("l_tax") / 10)).alias("ask"))
    return Y.quote_metrics(q).select("l_orderkey", "l_linenumber", "mid", "spread", "spread_bps", (F.col("p") * F.col("l_quantity")).alias("notional"))


@query("prj10_condition_spec", f"WITH {CROSS} SELECT event_id FROM ev WHERE direction = 'bullish' AND weekday = 2")
def _(spark, d):
    return Y.matching(W.crossovers(stored(spark, d, "daily")), {"direction": "bullish", "weekday": 2}).select("event_id")


@query("prj11_many_conditions", f"WITH {CROSS}, e AS (SELECT * FROM ev WHERE direction IS NOT NULL), m AS (SELECT 'bull' AS name, price FROM e WHERE direction = 'bullish' UNION ALL SELECT 'bear_mon', price FROM e WHERE direction = 'bearish' AND weekday = 0 UNION ALL SELECT 'fri', price FROM e WHERE weekday = 4) SELECT name, count(*) AS n, avg(price) AS mean FROM m GROUP BY 1", r="mean")
def _(spark, d):
    specs = {"bull": {"direction": "bullish"}, "bear_mon": {"direction": "bearish", "weekday": 0}, "fri": {"weekday": 4}, "unknown": {"no_such_field": 1}}
    return Y.matched_names(W.crossovers(stored(spark, d, "daily")), specs).groupBy("name").agg(F.count("*").alias("n"), F.avg("price").alias("mean"))


# --- more joins and aggregates ----------------------------------------------------------------------------------


@query("joi12_alignment", f"WITH a AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS pos, ts FROM hourly) SELECT x.pos FROM (SELECT * FROM a WHERE symbol = 'click') x FULL JOIN (SELECT * FROM a WHERE symbol = 'view') y ON x.pos = y.pos WHERE x.ts IS DISTINCT FROM y.ts AND x.pos IS NOT NULL", use="hourly")
def _(spark, d):
    own = S.row_index(hourly(spark, d), unit="day").select("symbol", F.col("idx").alias("pos"), "ts")
    return A.alignment_faults(own.where("symbol = 'click'"), own.where("symbol = 'view'")).where("target_ts is not null").select("pos")


@query("joi13_point_in_time", "SELECT o_orderkey, greatest(o_orderdate, o_orderdate + to_days((o_orderkey % 3)::INT) + to_days(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 5 END)) AS valid_from FROM orders", use="", t="valid_from")
def _(spark, d):
    lags = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 5), ("4-NOT SPECIFIED", 5), ("5-LOW", 5)], "factor string, days int")
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("factor"), F.col("o_orderdate").alias("event_ts"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 3).cast("int"))).alias("release_ts"))
    return Y.valid_from(o, lags).select("o_orderkey", "valid_from")


@query("agg04_dataset_statistics", f"WITH o AS (SELECT symbol, ts, volume, high - low AS spread, epoch(ts)::BIGINT - epoch({lag('ts')})::BIGINT AS dt FROM hourly), g AS (SELECT symbol, count(*) AS n, count(*) - count(DISTINCT ts) AS duplicates, sum((dt > 3600)::INT)::BIGINT AS gaps, (max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT)) // 3600 + 1 AS expected, avg(spread) AS mean_spread, avg(volume) AS mean_volume, count(DISTINCT ts::DATE) AS trading_days, datediff('day', min(ts), max(ts)) + 1 AS span FROM o GROUP BY 1) SELECT symbol, n, duplicates, gaps, expected, greatest(expected - n, 0) AS missing, least(100, greatest(expected - n, 0) * 100.0 / expected) AS missing_percent, n * 100.0 / expected AS completeness, mean_spread, mean_volume, trading_days, trading_days * 100.0 / span AS daily_coverage FROM g", use="hourly", r="missing_percent completeness mean_spread mean_volume daily_coverage")
def _(spark, d):
    own = stored(spark, d, "hourly").extend(lambda df: df.withColumn("spread", F.col("high") - F.col("low")))
    return Y.dataset_statistics(own, 3600)


@query("agg28_factor_attribution", "WITH f AS (SELECT symbol, regr_slope(high, low) AS b, var_samp(high) AS v, covar_samp(high, low) AS c FROM bars GROUP BY 1) SELECT symbol, b AS beta, b * c / v AS share FROM f", r="beta share")
def _(spark, d):
    return M.attribution(daily(spark, d), "high", ["low"]).select("symbol", "beta", "share")


@query("agg40_blended_transitions", f"WITH s AS (SELECT symbol, {_STATE} AS a, lead({_STATE}) OVER ({BY}) AS b FROM {R}), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM s WHERE b IS NOT NULL GROUP BY ALL), p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM c) SELECT a AS \"from\", b AS \"to\", 0.3 * p + 0.7 / 3 AS p FROM p", use="rets", r="p")
def _(spark, d):
    own = _states(spark, d)
    pairs = own.select("symbol", F.col("state").alias("from"), F.lead("state").over(W.series()).alias("to")).where("`to` is not null")
    counts = pairs.groupBy("from", "to").agg(F.count("*").alias("n"))
    seen = counts.select("from", "to", (F.col("n") / F.sum("n").over(Window.partitionBy("from"))).alias("p"))
    prior = seen.select("from", "to", F.lit(1 / 3).alias("prior"))
    return Y.blended(prior, seen, 0.3)


@query("agg42_matched_outcomes", f"WITH {OUTCOMES} SELECT direction, sum((ret > 0)::INT)::BIGINT AS positive, sum((ret < 0)::INT)::BIGINT AS negative, sum((ret = 0)::INT)::BIGINT AS flat, avg((ret > 0)::INT) AS ratio, avg(ret) AS mean FROM oc WHERE ret IS NOT NULL GROUP BY 1", r="ratio mean")
def _(spark, d):
    return Y.outcome_counts(_outcomes(spark, d), "ret", "direction")


@query("agg43_risk_contributions", f"WITH r AS (SELECT ts, symbol, r FROM {R} AND symbol IN ('1-URGENT', '5-LOW', '2-HIGH')), c AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) AS covar FROM r x JOIN r y USING (ts) GROUP BY 1, 2), w(s, w) AS (VALUES ('1-URGENT', 0.5::DOUBLE), ('5-LOW', 0.3), ('2-HIGH', 0.2)), p AS (SELECT c.a AS symbol, sum(wa.w * wb.w * covar) AS part FROM c JOIN w wa ON wa.s = c.a JOIN w wb ON wb.s = c.b GROUP BY 1) SELECT symbol, part, part / sum(part) OVER () AS share, sum(part) OVER () AS variance FROM p", use="rets", r="part share variance")
def _(spark, d):
    r = _returns(spark, d).where("symbol in ('1-URGENT', '5-LOW', '2-HIGH')").select("ts", "symbol", "r")
    covariance = r.select("ts", F.col("symbol").alias("a"), F.col("r").alias("ra")).join(r.select("ts", F.col("symbol").alias("b"), F.col("r").alias("rb")), "ts").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("covar"))
    return K.risk_contributions(covariance, spark.createDataFrame([("1-URGENT", 0.5), ("5-LOW", 0.3), ("2-HIGH", 0.2)], "symbol string, w double"))


@query("agg48_cross_asset_ratio", "WITH l AS (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY 1) SELECT a.symbol AS a, b.symbol AS b, a.c / b.c AS ratio FROM l a JOIN l b ON a.symbol < b.symbol", r="ratio")
def _(spark, d):
    return Y.latest_ratios(daily(spark, d))


@query("agg48_commodity_correlations", f"SELECT a.symbol, count(*) AS n, corr(a.r, b.r) AS corr FROM (SELECT * FROM {R}) a JOIN (SELECT * FROM {R}) b ON a.ts = b.ts AND b.symbol = '1-URGENT' AND a.symbol <> b.symbol GROUP BY 1", use="rets", r="corr")
def _(spark, d):
    """One series stands for the commodity, the others for what it is compared with."""
    return X.correlations_with(_returns(spark, d), "r", "1-URGENT")


@query("agg53_breusch_pagan", "WITH f AS (SELECT symbol, low, (high - (regr_intercept(high, low) OVER (PARTITION BY symbol) + regr_slope(high, low) OVER (PARTITION BY symbol) * low)) ** 2 AS e2 FROM bars) SELECT symbol, count(*) * regr_r2(e2, low) AS statistic FROM f GROUP BY 1", r="statistic")
def _(spark, d):
    return M.breusch_pagan(daily(spark, d), "high", ["low"])


@query("agg53_variance_inflation", "WITH f AS (SELECT symbol, 1 / (1 - corr(low, volume) ** 2) AS v FROM bars GROUP BY 1) SELECT symbol, 'low' AS factor, v AS vif FROM f UNION ALL SELECT symbol, 'volume', v FROM f", r="vif")
def _(spark, d):
    return M.inflation(daily(spark, d), ["low", "volume"])


@query("agg62_target_correlations", "SELECT 'open' AS factor, corr(close, open) AS corr FROM bars UNION ALL SELECT 'high', corr(close, high) FROM bars UNION ALL SELECT 'volume', corr(close, volume) FROM bars", r="corr")
def _(spark, d):
    return Y.target_correlations(daily(spark, d), "close", ["open", "high", "volume"])


@query("win21_regime_runs", f"WITH s AS (SELECT symbol, ts, r, {_STATE} AS st FROM {R}), b AS (SELECT *, CASE WHEN {lag('st')} IS DISTINCT FROM st THEN 1 ELSE 0 END AS w FROM s), c AS (SELECT *, sum(w) {SO_FAR} AS run FROM b) SELECT symbol, run::BIGINT AS run, min(st) AS state, min(ts) AS start, count(*) AS length, exp(sum(ln(1 + r))) - 1 AS total FROM c GROUP BY symbol, run", use="rets", r="total", t="start")
def _(spark, d):
    return Y.runs(_states(spark, d), "state", "r")


@query("win25_volatility_clustering", f"WITH c AS (SELECT symbol, ts, abs(r) AS x, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol) AS a, r * r - avg(r * r) OVER (PARTITION BY symbol) AS s FROM {R}) SELECT symbol, sum(a * p) / sum(a * a) AS acf_abs, sum(s * q) / sum(s * s) AS acf_squared, stddev_pop(x) / (avg(x) + 1e-12) AS clustering FROM (SELECT symbol, x, a, s, {lag('a')} AS p, {lag('s')} AS q FROM c) GROUP BY 1", use="rets", r="acf_abs acf_squared clustering")
def _(spark, d):
    from tidemark.operators.stats import autocorrelation

    own = _returns(spark, d).withColumns({"a": F.abs("r"), "s": F.col("r") * F.col("r")})
    first, second = (autocorrelation(own, c, 1).select("symbol", F.col("acf")[0].alias(n)) for c, n in (("a", "acf_abs"), ("s", "acf_squared")))
    return first.join(second, "symbol").join(own.groupBy("symbol").agg((F.stddev_pop("a") / (F.avg("a") + 1e-12)).alias("clustering")), "symbol")


@query("win26_breakouts", f"WITH o AS (SELECT symbol, close, max(high) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo, count(*) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS k FROM bars) SELECT symbol, avg((close > hi)::INT) AS up, avg((close < lo)::INT) AS down, count(*) AS n FROM o WHERE k = 20 GROUP BY 1", r="up down")
def _(spark, d):
    return Y.breakouts(daily(spark, d), 20)


_AHEAD = f"OVER ({BY} ROWS BETWEEN {{a}} FOLLOWING AND {{b}} FOLLOWING)"


@query("win26_trend_persistence", f"WITH w AS (SELECT symbol, sum(r) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a, sum(r) {_AHEAD.format(a=10, b=19)} AS b FROM {R}), c AS (SELECT symbol, count(*) FILTER (a * b > 0) AS s, count(*) FILTER (a * b < 0) AS t FROM w WHERE b IS NOT NULL GROUP BY 1) SELECT symbol, coalesce(s / nullif(s + t, 0), 0) AS persistence, coalesce(t / nullif(s + t, 0), 0) AS reversal FROM c", use="rets", r="persistence reversal")
def _(spark, d):
    return Y.trend_persistence(_returns(spark, d), "r", 10)


@query("win26_mean_reversion", f"WITH w AS (SELECT symbol, sum(r) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m, lead(r, 5) OVER ({BY}) AS n, lead(r, 6) OVER ({BY}) AS z FROM {R}), c AS (SELECT symbol, count(*) FILTER (m * n < 0) AS t, count(*) FILTER (m * n < 0 OR abs(m) > 0.001) AS k FROM w WHERE z IS NOT NULL GROUP BY 1) SELECT symbol, coalesce(t / nullif(k, 0), 0) AS mean_reversion FROM c", use="rets", r="mean_reversion")
def _(spark, d):
    return Y.mean_reversion(_returns(spark, d), "r", 5)


@query("win28_signal_votes", f"WITH o AS (SELECT symbol, ts, CASE WHEN close > {roll('avg', 'close', 20)} THEN 1 ELSE 0 END + CASE WHEN close > {roll('avg', 'close', 50)} THEN 1 ELSE 0 END + CASE WHEN r > 0 THEN 1 ELSE 0 END AS votes FROM rets) SELECT symbol, ts, votes::INT AS votes, CASE WHEN votes >= 2 THEN 'BUY' ELSE 'HOLD' END AS signal FROM o", use="rets", t="ts")
def _(spark, d):
    own = with_returns(daily(spark, d))
    flags = [F.col("close") > W.sma("close", 20), F.col("close") > W.sma("close", 50), F.col("r") > 0]
    return Y.votes(own, flags, 2)


@query("win38_best_per_group", "WITH c AS (SELECT o_orderpriority AS fold, o_custkey AS name, count(*) AS n, avg(o_totalprice / 997) AS score FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, n DESC, name) AS rn FROM c) SELECT fold, name, n, score FROM k WHERE rn = 1", use="", r="score")
def _(spark, d):
    c = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("fold"), F.col("o_custkey").alias("name")).agg(F.count("*").alias("n"), F.avg(F.col("o_totalprice") / 997).alias("score"))
    return Y.best(c, "fold")


@query("res14_feature_sweep", f"WITH f AS (SELECT symbol, close / {lag('close', 5)} - 1 AS m5, close / {lag('close', 10)} - 1 AS m10, lead(close, 5) OVER ({BY}) / close - 1 AS fwd FROM bars), l AS (SELECT 'm5' AS feature, m5 > 0 AS side, fwd FROM f WHERE m5 IS NOT NULL UNION ALL SELECT 'm10', m10 > 0, fwd FROM f WHERE m10 IS NOT NULL), t AS (SELECT feature, side, count(fwd) AS n, avg((fwd > 0)::INT) AS p_up, count(*) FILTER (fwd > 0) AS u, count(*) FILTER (fwd < 0) AS w FROM l WHERE fwd IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, CASE WHEN u + w = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(generate_series(0, least(u, w)), lambda i: exp(lgamma(u + w + 1) - lgamma(i + 1) - lgamma(u + w - i + 1) - (u + w) * ln(2))))) END AS p FROM t) SELECT feature, side, n, p_up, p, p * 4 < 0.05 AS significant FROM q", r="p_up p")
def _(spark, d):
    own = daily(spark, d).select("symbol", (F.col("close") / W.previous("close", 5) - 1).alias("m5"), (F.col("close") / W.previous("close", 10) - 1).alias("m10"), (F.lead("close", 5).over(W.series()) / F.col("close") - 1).alias("fwd"))
    return Y.feature_sweep(own, ["m5", "m10"], "fwd")


@query("res29_revisions", "WITH r AS (SELECT o_custkey AS object, o_orderkey AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision FROM orders) SELECT object, max(revision) AS latest, arg_max(payload, revision) AS payload, arg_max(payload, revision) FILTER (WHERE revision <= 2) AS as_of_2 FROM r GROUP BY 1", use="")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderkey").alias("payload"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("revision"))
    return Y.revisions(o, 2)


@query("top02_similar_snapshots", "WITH t AS (SELECT c_acctbal AS a FROM customer WHERE c_custkey = 1), s AS (SELECT c_custkey AS id, 1 / (1 + abs(c_acctbal - a) / 100) AS score FROM customer, t WHERE c_custkey <> 1) SELECT id, score FROM s WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 10", use="", r="score")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("a"))
    return I.similar_snapshots(c.where("id = 1"), c.where("id <> 1"), ["a"], 10, 0.5)


@query("top06_token_retrieval", "WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_]+|[0-9]+'))) AS w, len(list_distinct(regexp_extract_all(lower(text), '[a-z_]+|[0-9]+'))) AS n FROM benchmark), i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_]+|[0-9]+'))) AS w FROM documents), h AS (SELECT query_id, doc_id, n, count(*) AS hits FROM q JOIN i USING (w) GROUP BY 1, 2, 3), s AS (SELECT query_id, doc_id, hits, floor(least(1, hits / n * 0.1 * 10 * 0.5) * 1e4 + 0.5) / 1e4 AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, hits, score, rank FROM r WHERE rank <= 3", use="", r="score")
def _(spark, d):
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return I.token_overlap(read(spark, d, "documents"), queries, 3)


@query("top04_parameter_sweep", None, r="mean total best win_rate")
def _(spark, d):
    return I.sweep(stored(spark, d, "daily"), [(5, 20), (10, 30), (20, 60)], 5, 3, 0.001)


@query("gra07_append_only", "SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0", use="")
def _(spark, d):
    e = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("hash"), "o_orderkey")
    return G.append_only(e.where("o_orderkey % 10 <> 0"), e)[0].select("id")


@query("set05_coverage", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), s AS (SELECT DISTINCT event_type AS source, (ts + INTERVAL 6 HOUR)::DATE AS day FROM events WHERE value > 20) SELECT t.source, count(*) AS lacking FROM (SELECT DISTINCT event_type AS source FROM events) t, d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = t.source AND s.day = d.day) GROUP BY 1", use="")
def _(spark, d):
    e = read(spark, d, "events")
    return Y.coverage(e.where("value > 20").select(F.col("event_type").alias("source"), F.to_date(F.col("ts") + F.expr("interval 6 hours")).alias("day")), e.select(F.to_date("ts").alias("day")), e.select(F.col("event_type").alias("source")))


# --- streams ----------------------------------------------------------------------------------------------------


@query("str01_sliding_windows", "SELECT event_type, w AS start, w + INTERVAL 1 HOUR AS stop, count(*) AS n, avg(value) AS mean FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2", use="", r="mean", t="start stop")
def _(spark, d):
    return J.drain(J.windows(J.stream_table(spark, f"{d}/events.parquet"), "1 hour", "30 minutes"), "complete")


@query("str03_live_bars", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2", use="", r="open high low close", t="ts")
def _(spark, d):
    e = J.stream_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))
    return J.drain(J.live_bars(e, "1 hour"), "complete")


@query("str07_activity", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS w FROM events), c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM c GROUP BY user_id, s", use="", t="start")
def _(spark, d):
    return J.drain(J.activity(J.stream_table(spark, f"{d}/events.parquet"), "6 hours"), "complete")


@query("str08_against_history", "WITH b AS (SELECT event_type AS symbol, ts::DATE AS day, avg(value) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2) SELECT event_type AS symbol, e.ts::DATE::TIMESTAMP AS day, e.event_id, (e.value - b.close) / b.close AS close_diff, 1 / b.volume AS volume_ratio FROM events e JOIN b ON b.symbol = e.event_type AND b.day = e.ts::DATE", use="", r="close_diff volume_ratio", t="day")
def _(spark, d):
    history = read(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))
    live = J.stream_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").alias("day"), F.col("value").alias("close"), F.lit(1.0).alias("volume"), "event_id")
    past = history.select("symbol", "day", F.col("close").alias("past_close"), F.col("volume").alias("past_volume"))
    both = live.join(past, ["symbol", "day"]).select("symbol", "day", "event_id", ((F.col("close") - F.col("past_close")) / F.col("past_close")).alias("close_diff"), (F.col("volume") / F.col("past_volume")).alias("volume_ratio"))
    return J.drain(both, "append")
