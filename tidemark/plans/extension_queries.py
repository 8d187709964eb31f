"""Queries: users' own indicators, rules, labels and statistics, count windows, live signals and subscriptions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import extension as E
from tidemark.operators import frame as P
from tidemark.operators import walk as K
from tidemark.operators import windows as W
from tidemark.plans.analysis_queries import OUTCOMES, _outcomes
from tidemark.plans.registry import BY, daily, lag, over, query, read, roll, with_returns
from tidemark.sources.scratch import scratch
from tidemark.streaming import jobs as J


@query("udf01_indicator_registry", f"WITH o AS (SELECT symbol, ts, {roll('avg', 'close', 10)} AS sma, {roll('avg', 'close', 20)} AS mid, {roll('stddev_pop', 'close', 20)} AS sd FROM bars) SELECT symbol, ts, 'sma' AS indicator, 'sma' AS field, sma AS value FROM o UNION ALL SELECT symbol, ts, 'bollinger', 'mid', mid FROM o UNION ALL SELECT symbol, ts, 'bollinger', 'upper', mid + 1.5 * sd FROM o UNION ALL SELECT symbol, ts, 'bollinger', 'lower', mid - 1.5 * sd FROM o", r="value", t="ts")
def _(spark, d):
    return E.compute_batch(daily(spark, d), [("sma", {"period": 10}), ("bollinger", {"std_dev": 1.5})])


@query("udf02_user_condition", f"WITH {OUTCOMES}, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n FROM oc WHERE horizon_days = 1) SELECT k::INT AS fold, count(*) FILTER (WHERE ret IS NOT NULL AND mfe > 0.01) AS n_test FROM n, range(100000) AS t(k) WHERE 140 + k * 40 <= n AND idx >= 100 + k * 40 AND idx < 140 + k * 40 GROUP BY 1")
def _(spark, d):
    events = K.numbered(_outcomes(spark, d).where("horizon_days = 1"))
    return K.validate_condition(events, F.col("mfe") > 0.01, "ret", (60, 40, 40, 40)).select("fold", "n_test")


@query("udf03_mapped_records", "SELECT symbol, ts, (high + low) / 2 AS middle FROM bars WHERE close > open AND volume >= 1", r="middle", t="ts")
def _(spark, d):
    return E.mapped(daily(spark, d), {"middle": (F.col("high") + F.col("low")) / 2}, (F.col("close") > F.col("open")) & (F.col("volume") >= 1)).select("symbol", "ts", "middle")


@query("udf03_mapped_frames", "SELECT symbol, ts, ln(1 + volume) AS log_volume FROM bars", r="log_volume", t="ts")
def _(spark, d):
    return E.mapped_frames(daily(spark, d).select("symbol", "ts", "volume"), lambda rows: rows.assign(log_volume=np.log1p(rows["volume"])).drop(columns="volume"), "symbol string, ts timestamp, log_volume double")


@query("udf04_user_strategy", f"SELECT symbol, ts, CASE WHEN close > {lag('close', 3)} THEN 1 WHEN close < {lag('close', 3)} THEN -1 ELSE 0 END AS signal FROM bars", t="ts")
def _(spark, d):
    return E.strategy(daily(spark, d), lambda rows: rows["close"] - rows["close"].shift(3)).select("symbol", "ts", "signal")


@query("udf05_user_labels", f"SELECT symbol, ts, r, CASE WHEN volume >= 2 THEN 1 ELSE 0 END AS label FROM rets WHERE dayofmonth(ts) <> 2", use="rets", r="r", t="ts")
def _(spark, d):
    bars = daily(spark, d)
    labels = bars.where(F.dayofmonth("ts") != 2).select("symbol", "ts", F.when(F.col("volume") >= 2, 1).otherwise(0).alias("busy"))
    return E.with_labels(with_returns(bars).select("symbol", "ts", "r"), labels, "busy")


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    at = np.searchsorted(np.cumsum(weights), weights.sum() / 2)
    return values[min(at, len(values) - 1)]


@query("udf06_bootstrap_median", None, r="lo hi mean")
def _(spark, d):
    e = read(spark, d, "events")
    return E.bootstrap_statistic(e, "value", "event_id", "event_type", _median)


@query("str02_count_windows", "WITH n AS (SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events), w AS (SELECT symbol, k, ts, avg(value) OVER z AS mean, last_value(ts) OVER z AS last_ts, count(*) OVER z AS c FROM n WINDOW z AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT symbol, k AS start, ts AS first_ts, last_ts, mean FROM w WHERE c = 20 AND k % 5 = 0", use="", r="mean", t="first_ts last_ts")
def _(spark, d):
    rows = J.stream_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value")
    return J.drain(J.count_windows(rows, 20, 5), "append")


@query("str05_live_signals", "WITH RECURSIVE n AS (SELECT event_type AS symbol, ts, value AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events), e AS (SELECT symbol, k, close AS q, close AS l, 0.0::DOUBLE AS line FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.k, e.q + (n.close - e.q) * 2 / 13, e.l + (n.close - e.l) * 2 / 27, e.line + (e.q + (n.close - e.q) * 2 / 13 - (e.l + (n.close - e.l) * 2 / 27) - e.line) * 2 / 10 FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1), m AS (SELECT n.symbol, n.ts, n.k, n.close, CASE WHEN n.k >= 10 THEN avg(n.close) OVER (PARTITION BY n.symbol ORDER BY n.k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS fast, CASE WHEN n.k >= 30 THEN avg(n.close) OVER (PARTITION BY n.symbol ORDER BY n.k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS slow, q - l AS macd, line FROM n JOIN e USING (symbol, k)), g AS (SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY k) AS before FROM (SELECT *, round(fast - slow, 9) AS gap FROM m)) SELECT symbol, ts, close, fast, slow, macd, line, CASE WHEN before <= 0 AND gap > 0 THEN 1 WHEN before >= 0 AND gap < 0 THEN -1 ELSE 0 END AS signal FROM g", use="", r="close fast slow macd line", t="ts")
def _(spark, d):
    rows = J.stream_table(spark, f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("close"))
    return J.drain(J.live_crossovers(rows), "append")


@query("str09_subscriptions", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1", use="", r="total", digits=4)
def _(spark, d):
    out = scratch(spark)
    topics = {t: (lambda rows, t=t: rows.write.mode("append").parquet(f"{out}/{t}")) for t in ("click", "purchase")}
    J.fan_out(J.stream_table(spark, f"{d}/events.parquet"), topics).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema("event_type string, value double").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
