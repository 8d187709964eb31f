"""Queries: audits of feeds, events, partitions and stored results, and the record store's reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalar as C
from tidemark.operators import asof as A
from tidemark.operators import audit as U
from tidemark.operators import bars as B
from tidemark.operators import folds as V
from tidemark.operators import labels as L
from tidemark.operators import lineage as G
from tidemark.operators import memory as N
from tidemark.operators import quality as Q
from tidemark.operators import retrieval as I
from tidemark.operators import scan as R
from tidemark.operators import windows as W
from tidemark.plans.analysis_queries import _EDGES, _FEEDS, OUTCOMES, _edges, _feeds, _outcomes
from tidemark.plans.registry import BY, daily, hourly, lag, over, query, read, stored, ticks
from tidemark.plans.window_queries import CROSS
from tidemark.sources import csv as csv_source
from tidemark.sources import tables
from tidemark.sources.scratch import scratch

# --- sources ----------------------------------------------------------------------------------------------------


@query("src04_auto_detection", "SELECT symbol, ts, open, high, low, close, volume FROM hourly WHERE symbol IN ('click', 'view')", use="hourly", r="open high low close volume", t="ts")
def _(spark, d):
    h, terminal, chart = hourly(spark, d), scratch(spark), scratch(spark)
    names = {"open": "<OPEN>", "high": "<HIGH>", "low": "<LOW>", "close": "<CLOSE>", "volume": "<VOL>"}
    h.where("symbol = 'click'").select(F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"), *[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).option("sep", "\t").csv(terminal)
    h.where("symbol = 'view'").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), *names).write.option("header", True).csv(chart)
    return csv_source.load_auto(spark, terminal, "click", "1h").unionByName(csv_source.load_auto(spark, chart, "view", "1h")).drop("timeframe")


@query("src07_named_sources", "SELECT symbol, count(*) AS n, max(close) AS highest FROM bars GROUP BY 1", r="highest")
def _(spark, d):
    path = scratch(spark)
    daily(spark, d).write.parquet(path)
    tables.register(spark, "tidemark_daily", path)
    return spark.table("tidemark_daily").groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("highest"))


@query("src09_epoch_unit", "SELECT event_id, date_trunc('second', ts) AS s, ts AS ms FROM events", use="", t="s ms")
def _(spark, d):
    own = read(spark, d, "events").select("event_id", F.unix_seconds("ts").alias("a"), F.unix_millis("ts").alias("b"))
    return csv_source.from_epoch(csv_source.from_epoch(own, "a", "s"), "b", "ms").select("event_id", "s", "ms")


@query("src10_utc_normalisation", "SELECT event_id, ts - to_minutes(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -300 END) AS utc FROM events", use="", t="utc")
def _(spark, d):
    zone = F.when(F.col("event_id") % 3 == 0, "UTC").when(F.col("event_id") % 3 == 1, "+05:30").otherwise("-05:00")
    return read(spark, d, "events").select("event_id", csv_source.utc(F.col("ts"), zone).alias("utc"))


@query("src11_load_gate", "SELECT symbol, count(*) AS n FROM bars WHERE close > 0 GROUP BY 1")
def _(spark, d):
    return csv_source.gate(daily(spark, d).where("close > 0"), ["symbol", "ts"], ["close"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("src13_signal_sink", "SELECT symbol, ts, ts + INTERVAL 1 DAY AS valid_from, CASE WHEN close > open THEN 'BUY' ELSE 'SELL' END AS signal, 0.5::DOUBLE AS confidence FROM bars", t="ts valid_from")
def _(spark, d):
    path = scratch(spark)
    s = daily(spark, d).select("symbol", "ts", (F.col("ts") + F.expr("interval 1 day")).alias("valid_from"), F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL").alias("signal"), F.lit(0.5).alias("confidence"))
    tables.write_signals(s, path)
    return spark.read.option("header", True).schema(s.schema).csv(path)


@query("src14_dataset_export", f"SELECT symbol, count(*) AS n, sum(r) AS features, sum(label)::BIGINT AS labels, 0::BIGINT AS apart FROM (SELECT symbol, r, CASE WHEN {lag('close')} IS NULL THEN NULL WHEN lead(close) OVER ({BY}) > close THEN 1 ELSE 0 END AS label FROM rets) WHERE r IS NOT NULL AND label IS NOT NULL GROUP BY 1", use="rets", r="features")
def _(spark, d):
    from tidemark.plans.registry import with_returns

    own = with_returns(daily(spark, d)).select("symbol", "ts", "r", F.when(F.lead("close").over(W.series()) > F.col("close"), 1).otherwise(0).alias("label")).where("r is not null")
    as_csv, as_json = tables.export_dataset(own, scratch(spark))
    a, b = (x.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("r").alias("features"), F.sum("label").alias("labels")) for x in (as_csv, as_json))
    same = b.select("symbol", F.col("n").alias("_n"), F.col("labels").alias("_l"))
    return a.join(same, "symbol").select("symbol", "n", "features", "labels", (F.abs(F.col("n") - F.col("_n")) + F.abs(F.col("labels") - F.col("_l"))).alias("apart"))


# --- projections and reads --------------------------------------------------------------------------------------


@query("prj02_snapshot_features", "SELECT symbol, ts, CASE WHEN close <> 0 THEN (high - low) / close * 100 ELSE 0 END AS range_pct, CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS body_pct, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_position, close > open AS is_bullish FROM bars", r="range_pct body_pct close_position", t="ts")
def _(spark, d):
    return N.snapshot_features(daily(spark, d)).select("symbol", "ts", "range_pct", "body_pct", "close_position", "is_bullish")


@query("prj04_notional", "SELECT l_orderkey, l_linenumber, l_extendedprice / 997 * l_quantity AS notional FROM lineitem", use="", r="notional", digits=4)
def _(spark, d):
    trades = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 997).alias("price"), F.col("l_quantity").alias("volume"))
    return B.with_notional(trades).select("l_orderkey", "l_linenumber", "notional")


@query("prj07_limit_per_symbol", f"SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars WHERE symbol IN ('1-URGENT', '5-LOW') AND ts BETWEEN '1995-03-01' AND '1997-03-01') WHERE k <= 25", r="close", t="ts")
def _(spark, d):
    return B.range_query(daily(spark, d), ["1-URGENT", "5-LOW"], "1995-03-01", "1997-03-01", ["symbol", "ts", "close"], 25, descending=True)


@query("prj09_records_of_dataset", "SELECT symbol, ts, close FROM bars WHERE symbol = '2-HIGH' AND ts BETWEEN '1996-01-01' AND '1996-12-31' ORDER BY ts LIMIT 40", r="close", t="ts")
def _(spark, d):
    path = scratch(spark)
    tables.save(daily(spark, d), path)
    return tables.records(spark, path, "2-HIGH", "1996-01-01", "1996-12-31", 40).select("symbol", "ts", "close")


@query("prj12_calendar_filters", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup') AND upper(CASE user_id % 2 WHEN 0 THEN 'us' ELSE 'De' END) = 'US'", use="")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "signup", "high").otherwise("low").alias("severity"), F.when(F.col("user_id") % 2 == 0, "us").otherwise("De").alias("country"))
    return N.of_country(N.severe(e), "Us").select("event_id")


@query("prj14_feature_assembly", f"WITH a AS (SELECT symbol, ts, close - open AS body, high - low AS span FROM bars), b AS (SELECT *, CASE WHEN span > 0 THEN body / span ELSE 0 END AS share FROM a) SELECT symbol, ts, body, span, share, abs(share) AS strength FROM b", r="body span share strength", t="ts")
def _(spark, d):
    definitions = {
        "strength": (["share"], F.abs("share")),
        "share": (["body", "span"], F.when(F.col("span") > 0, F.col("body") / F.col("span")).otherwise(0.0)),
        "span": (["high", "low"], F.col("high") - F.col("low")),
        "body": (["open", "close"], F.col("close") - F.col("open")),
    }
    return B.assemble(daily(spark, d), definitions).select("symbol", "ts", *sorted(definitions))


@query("prj15_z_flags", "WITH z AS (SELECT symbol, ts, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_pop(close) OVER (PARTITION BY symbol) AS z FROM bars) SELECT symbol, ts, z, CASE WHEN abs(z) < 1 THEN 'normal' WHEN abs(z) < 2 THEN 'elevated' WHEN abs(z) < 3 THEN 'high' ELSE 'extreme' END AS bucket, abs(z) >= 2 AS flag FROM z", r="z", t="ts")
def _(spark, d):
    own = B.scaled(daily(spark, d), "close")
    return own.select("symbol", "ts", "z", B.z_bucket(F.col("z")).alias("bucket"), (F.abs("z") >= 2).alias("flag"))


@query("prj16_memory_scans", f"WITH {CROSS}, e AS (SELECT * FROM ev WHERE direction IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id) AS k FROM e WHERE ts >= '1996-01-01') SELECT 'recent' AS scan, event_id FROM r WHERE k <= 3 UNION ALL SELECT 'asset', event_id FROM e WHERE symbol = '2-HIGH' AND direction = 'bullish'")
def _(spark, d):
    e = W.crossovers(stored(spark, d, "daily"))
    recent = N.recent(N.in_range(e, "1996-01-01", None), 3)
    asset = N.of_asset(e, "2-HIGH").where("direction = 'bullish'")
    return recent.select(F.lit("recent").alias("scan"), "event_id").unionByName(asset.select(F.lit("asset").alias("scan"), "event_id"))


@query("top01_sorted_page", "SELECT symbol, ts, close FROM bars ORDER BY ts DESC, symbol LIMIT 50 OFFSET 20", r="close", t="ts")
def _(spark, d):
    return B.page(daily(spark, d), [F.desc("ts"), F.asc("symbol")], 20, 50).select("symbol", "ts", "close")


_SCEN = "f AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_totalprice <> 0 THEN (o_orderkey % 13) / (o_totalprice / 99700) * 100 ELSE 0 END AS range_pct, (o_orderkey % 7) / 7 AS body, o_orderkey % 2 = 0 AS up, (o_orderkey % 5) / 5 AS pos, (o_orderkey % 9) / 3 AS vol FROM orders), q AS (SELECT * FROM f WHERE id % 100 = 0), p AS (SELECT q.id AS query_id, f.c AS scenario, f.id, 0.25 * (1 - greatest(0, least(1, abs(q.range_pct - f.range_pct) / 10))) + 0.20 * (1 - abs(q.body - f.body)) + 0.25 * (q.up = f.up)::INT + 0.15 * (1 - abs(q.pos - f.pos)) + 0.15 * (1 - greatest(0, least(1, abs(q.vol - f.vol) / 5))) AS score FROM q, f WHERE q.id <> f.id), s AS (SELECT query_id, scenario, avg(greatest(0, least(1, score))) AS score, count(*) AS n FROM p GROUP BY 1, 2)"


def _snapshots(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("scenario"), F.when(F.col("o_totalprice") != 0, (k % 13) / (F.col("o_totalprice") / 99700) * 100).otherwise(0.0).alias("range_pct"), ((k % 7) / 7).alias("body_pct"), (k % 2 == 0).alias("is_bullish"), ((k % 5) / 5).alias("close_position"), ((k % 9) / 3).alias("volatility"))


@query("joi14_scenario_scores", f"WITH {_SCEN} SELECT scenario, count(*) AS queries, avg(score) AS mean, max(score) AS best FROM s GROUP BY 1", use="", r="mean best")
def _(spark, d):
    own = _snapshots(spark, d)
    return N.scenario_summary(own.where("id % 100 = 0"), own)


@query("top03_scenario_matches", f"WITH {_SCEN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, scenario) AS rank FROM s WHERE score >= 0.3) SELECT query_id, rank, scenario, score FROM k WHERE rank <= 5", use="", r="score")
def _(spark, d):
    own = _snapshots(spark, d)
    return N.scenario_matches(own.where("id % 100 = 0"), own, 5, 0.3).select("query_id", "rank", "scenario", "score")


@query("fun04_timeframes", "SELECT symbol, count(*) AS n FROM (SELECT symbol, to_timestamp(floor(epoch(ts) / 604800) * 604800) AS w FROM bars GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return B.resample(daily(spark, d), S.timeframe_seconds(" Week ")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("fun05_math", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS ratio, greatest(0.1, least(0.5, l_quantity / 50)) AS clamped, ln(l_quantity) AS log FROM lineitem", use="", r="ratio clamped log")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.safe_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio"), C.clamp(F.col("l_quantity") / 50, 0.1, 0.5).alias("clamped"), F.log("l_quantity").alias("log"))


@query("fun06_arrays", "WITH a AS (SELECT l_orderkey, list(l_suppkey) AS s, list(l_quantity) AS q, list(l_partkey % 10) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(s)), ',') AS suppliers, list_max(q) AS most, list_min(q) AS least, len(list_distinct(list_intersect(t, [1, 2, 3])))::INT AS hits FROM a", use="", r="most least")
def _(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), (F.col("l_partkey") % 10).alias("t"))).alias("a"))
    return own.select("l_orderkey", F.array_join(C.sorted_unique(C.field("a", "s")), ",").alias("suppliers"), F.array_max(C.field("a", "q")).alias("most"), F.array_min(C.field("a", "q")).alias("least"), F.size(F.array_intersect(C.field("a", "t"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]))).alias("hits"))


# --- checks -----------------------------------------------------------------------------------------------------


@query("qa06_bar_rules", "SELECT symbol, count(*) AS n, sum((low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0)::INT)::BIGINT AS valid FROM (SELECT * REPLACE (CASE WHEN dayofmonth(ts) = 7 THEN low - 1e6 ELSE low END AS low) FROM bars) GROUP BY 1")
def _(spark, d):
    own = daily(spark, d).withColumn("low", F.when(F.dayofmonth("ts") == 7, F.col("low") - 1e6).otherwise(F.col("low")))
    return own.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(Q.valid_bar()).alias("valid"))


_MINUTES = "m AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, CASE WHEN event_id % 31 = 0 THEN -1 ELSE value + 1 END AS open, value + 2 AS high, CASE WHEN event_id % 37 = 0 THEN value + 3 ELSE value END AS low, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value + 1 END AS close, CASE WHEN event_id % 43 = 0 THEN -1 ELSE 1 END::DOUBLE AS tick_volume, 0.0::DOUBLE AS real_volume, CASE WHEN event_id % 47 = 0 THEN NULL ELSE 2 END::DOUBLE AS spread FROM events)"


@query("qa08_minute_feed", f"WITH {_MINUTES}, c AS (SELECT symbol, count(*) AS n, 0::BIGINT AS missing_ts, sum((ts < '2024-01-03' OR ts > '2024-01-20')::INT)::BIGINT AS out_of_range, sum((NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND high >= low, false))::INT)::BIGINT AS invalid_prices, sum((tick_volume < 0)::INT)::BIGINT AS invalid_volumes, sum((spread IS NULL)::INT)::BIGINT AS invalid_spreads FROM m GROUP BY 1), u AS (SELECT symbol, ts, count(*) AS c FROM m GROUP BY 1, 2), g AS (SELECT symbol, c, epoch(ts)::BIGINT - epoch({lag('ts')})::BIGINT AS d FROM u), s AS (SELECT symbol, count(*) AS times, sum(c - 1)::BIGINT AS duplicates, max(d) AS max_gap, sum((d > 60)::INT)::BIGINT AS gaps FROM g GROUP BY 1) SELECT * FROM c JOIN s USING (symbol)", use="")
def _(spark, d):
    k, v = F.col("event_id"), F.col("value")
    m = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("ts"), F.when(k % 31 == 0, -1.0).otherwise(v + 1).alias("open"), (v + 2).alias("high"), F.when(k % 37 == 0, v + 3).otherwise(v).alias("low"), F.when(k % 41 != 0, v + 1).alias("close"), F.when(k % 43 == 0, -1.0).otherwise(1.0).alias("tick_volume"), F.lit(0.0).alias("real_volume"), F.when(k % 47 != 0, 2.0).alias("spread"))
    return U.minute_feed(m, "2024-01-03", "2024-01-20")


@query("qa09_gap_kinds", f"WITH g AS (SELECT symbol, {lag('ts')} AS a, ts AS b FROM bars), c AS (SELECT symbol, a, b, CASE WHEN len(list_filter(generate_series(a, b, INTERVAL 1 DAY), lambda x: isodow(x) >= 6)) > 0 THEN 'weekend_overlap_candidate' ELSE 'non_weekend_suspicious' END AS kind FROM g WHERE b - a > INTERVAL 1 DAY) SELECT symbol, kind, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, d):
    g = daily(spark, d).select("symbol", F.lag("ts").over(W.series()).alias("a"), F.col("ts").alias("b")).where(F.unix_timestamp("b") - F.unix_timestamp("a") > 86400)
    return g.groupBy("symbol", U.gap_kind(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@query("qa11_feed_grade", f"WITH {_FEEDS}, c AS (SELECT symbol, corr(a, b) AS corr, avg(abs(a - b) / abs(a)) AS mape FROM fa JOIN fb USING (symbol, ts) WHERE a <> 0 GROUP BY 1) SELECT symbol, CASE WHEN corr > 0.99 AND mape < 0.01 THEN 'EXCELLENT' WHEN corr > 0.95 AND mape < 0.05 THEN 'GOOD' ELSE 'POOR' END AS grade FROM c", use="")
def _(spark, d):
    a, b = _feeds(spark, d)
    return A.quality_grade(A.compare_feeds(a.where("close <> 0 or close is null"), b)).select("symbol", "grade")


_EV = f"{OUTCOMES}, x AS (SELECT event_id, symbol, ts, 'cross' AS event_type, direction, CASE WHEN dayofmonth(ts) = 3 THEN ts - INTERVAL 1 DAY ELSE ts END AS outcome_ts, realized_end FROM oc WHERE horizon_days = 5), cc AS (SELECT direction || dayofmonth(ts) AS name, count(*) AS n, avg((ret > 0)::INT) AS p FROM oc WHERE horizon_days = 5 AND ret IS NOT NULL GROUP BY 1)"


@query("qa12_self_audit", f"WITH {_EV}, mk AS (SELECT symbol, ts AS t, 1 AS s FROM x WHERE realized_end IS NOT NULL UNION ALL SELECT symbol, realized_end, -1 FROM x WHERE realized_end IS NOT NULL), ov AS (SELECT s, sum(s) OVER (PARTITION BY symbol ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS o FROM mk) SELECT 'missing_provenance' AS \"check\", 0::BIGINT AS n UNION ALL SELECT 'missing_realized_end', count(*) FILTER (WHERE realized_end IS NULL) FROM x UNION ALL SELECT 'future_leakage', count(*) FILTER (WHERE outcome_ts < ts) FROM x UNION ALL SELECT 'duplicate_events', 0 UNION ALL SELECT 'timestamp_violations', 0 UNION ALL SELECT 'overlapping_labels', sum(o - 1)::BIGINT FROM ov WHERE s = 1 UNION ALL SELECT 'insufficient_sample_size', count(*) FILTER (WHERE n < 5) FROM cc UNION ALL SELECT 'condition_explosion', (count(*) > 10)::BIGINT FROM cc UNION ALL SELECT 'multiple_testing', (count(*) > 1)::BIGINT FROM cc UNION ALL SELECT 'invalid_probability', count(*) FILTER (WHERE n > 0 AND abs(p - 0.5) > 0.45 AND n < 10) FROM cc")
def _(spark, d):
    oc = _outcomes(spark, d).where("horizon_days = 5")
    e = oc.select("event_id", "symbol", "ts", F.lit("cross").alias("event_type"), "direction", F.when(F.dayofmonth("ts") == 3, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts")).alias("outcome_ts"), "realized_end", F.unix_timestamp("ts").alias("seq"))
    c = oc.where("ret is not null").groupBy(F.concat("direction", F.dayofmonth("ts").cast("string")).alias("name")).agg(F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("p"))
    return U.self_audit(e, c)


_PARTS = f"{OUTCOMES}, pr AS (SELECT event_id, ts, realized_end, horizon_days AS fold, CASE WHEN ts < '1996-01-01' THEN 'train' WHEN ts < '1997-01-01' THEN 'validation' ELSE 'test' END AS role FROM oc WHERE realized_end IS NOT NULL AND (horizon_days <> 5 OR dayofyear(ts) < 330))"


@query("qa13_label_leaks", f"WITH {_PARTS} SELECT fold, max(realized_end) FILTER (WHERE role = 'train') >= min(ts) FILTER (WHERE role = 'validation') AS into_validation, max(realized_end) FILTER (WHERE role = 'validation') >= min(ts) FILTER (WHERE role = 'test') AS into_test, 0::BIGINT AS without_end FROM pr GROUP BY 1")
def _(spark, d):
    oc = _outcomes(spark, d).where((F.col("realized_end").isNotNull()) & ((F.col("horizon_days") != 5) | (F.dayofyear("ts") < 330)))
    role = F.when(F.col("ts") < "1996-01-01", "train").when(F.col("ts") < "1997-01-01", "validation").otherwise("test")
    return U.label_leaks(oc.select(F.col("horizon_days").alias("fold"), role.alias("role"), "ts", "realized_end"))


@query("qa15_production_gate", "WITH e AS (SELECT CASE WHEN event_type = 'view' THEN 'Mock feed' ELSE event_type END AS source, event_id, ts, CASE WHEN event_type = 'click' AND event_id % 50 = 0 THEN NULL WHEN event_type = 'signup' AND event_id % 40 = 0 THEN event_id + 1 ELSE event_id END AS oid FROM events), g AS (SELECT source, count(*) AS events, 0::BIGINT AS disorder, count(*) FILTER (WHERE oid IS NULL) AS missing_outcome, count(*) FILTER (WHERE oid <> event_id) AS identity, 0::BIGINT AS time, source = 'Mock feed' AS blocked FROM e GROUP BY 1) SELECT *, NOT blocked AND events >= 100 AND missing_outcome + identity = 0 AS passed FROM g", use="")
def _(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    e = read(spark, d, "events").select(F.when(kind == "view", "Mock feed").otherwise(kind).alias("source"), "event_id", "ts", F.unix_micros("ts").alias("seq"), F.when((kind == "click") & (k % 50 == 0), None).when((kind == "signup") & (k % 40 == 0), k + 1).otherwise(k).alias("outcome_event_id"), F.col("ts").alias("outcome_ts"))
    return U.production_gate(e)


@query("qa19_dataset_checks", f"WITH f AS (SELECT symbol, ts, r, {lag('r')} AS r1 FROM rets), l AS (SELECT symbol, ts, CASE WHEN dayofmonth(ts) = 9 THEN NULL ELSE 1 END AS label FROM bars WHERE dayofmonth(ts) <> 28), j AS (SELECT f.ts AS a, l.ts AS b, r, r1, label FROM f FULL JOIN l USING (symbol, ts)) SELECT 'r' AS \"check\", count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND r IS NULL) AS n FROM j UNION ALL SELECT 'r1', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND r1 IS NULL) FROM j UNION ALL SELECT 'label', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NULL) FROM j UNION ALL SELECT 'without_label', count(*) FILTER (WHERE b IS NULL) FROM j UNION ALL SELECT 'without_features', count(*) FILTER (WHERE a IS NULL) FROM j UNION ALL SELECT 'samples', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) FROM j", use="rets")
def _(spark, d):
    from tidemark.plans.registry import with_returns

    bars = daily(spark, d)
    features = with_returns(bars).select("symbol", "ts", "r").withColumn("r1", W.previous("r"))
    labels = bars.where(F.dayofmonth("ts") != 28).select("symbol", "ts", F.when(F.dayofmonth("ts") != 9, 1).alias("label"))
    return U.dataset_faults(features, labels, ["r", "r1"])


@query("qa20_session_boundaries", "WITH a AS (SELECT symbol, ts::DATE AS day, count(*) AS rows_a, count(DISTINCT ts) AS times_a, min(ts) AS first_a, max(ts) AS last_a, max(high) AS high_a, min(low) AS low_a FROM hourly GROUP BY 1, 2), b AS (SELECT symbol, ts::DATE AS day, count(*) AS rows_b, count(DISTINCT ts) AS times_b, min(ts) AS first_b, max(ts) AS last_b, max(high) AS high_b, min(low) AS low_b FROM hourly WHERE hour(ts) BETWEEN 6 AND 18 GROUP BY 1, 2) SELECT * FROM a FULL JOIN b USING (symbol, day)", use="hourly", r="high_a low_a high_b low_b", t="day first_a last_a first_b last_b")
def _(spark, d):
    h = hourly(spark, d)
    return U.session_boundaries(h, h.where(F.hour("ts").between(6, 18)))


@query("qa21_continuity", "WITH c AS (SELECT ts AS day, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY 1), r AS (SELECT day, close * CASE WHEN dayofmonth(day) = 5 THEN 1.01 ELSE 1 END AS close, volume FROM c WHERE dayofmonth(day) <> 1) SELECT 'close' AS \"column\", count(*) AS n, count(*) FILTER (WHERE c.close <> r.close) AS differ, avg(abs(c.close - r.close) / r.close) AS mean_gap, max(abs(c.close - r.close) / r.close) AS max_gap FROM c JOIN r USING (day) UNION ALL SELECT 'volume', count(*), count(*) FILTER (WHERE c.volume <> r.volume), avg(abs(c.volume - r.volume) / r.volume), max(abs(c.volume - r.volume) / r.volume) FROM c JOIN r USING (day)", r="mean_gap max_gap")
def _(spark, d):
    c = daily(spark, d).groupBy(F.col("ts").alias("day")).agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    path = scratch(spark)
    c.write.parquet(path)
    c = spark.read.parquet(path)
    r = c.where(F.dayofmonth("day") != 1).withColumn("close", F.col("close") * F.when(F.dayofmonth("day") == 5, 1.01).otherwise(1.0))
    return U.continuity(c, r, ["close", "volume"])


@query("qa22_recheck", "WITH r AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, CASE symbol WHEN '2-HIGH' THEN 'differs' ELSE 'missing' END AS fault FROM r WHERE symbol IN ('2-HIGH', '5-LOW') UNION ALL SELECT 'gone', 'unknown'")
def _(spark, d):
    now = daily(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("close").alias("mean"))
    stored = now.where("symbol <> '5-LOW'").withColumn("mean", F.col("mean") + F.when(F.col("symbol") == "2-HIGH", 0.5).otherwise(0.0))
    stored = stored.unionByName(now.where("symbol = '5-LOW'").withColumn("symbol", F.lit("gone")))
    return U.recheck(stored, now, ["symbol"], ["n", "mean"])


# --- joins, sets and lineage ------------------------------------------------------------------------------------


@query("joi09_fold_rows", f"WITH i AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx FROM bars), f AS (SELECT k::INT AS fold, 100 + k * 50 AS lo, 150 + k * 50 AS hi FROM (SELECT unnest(range(max(idx) // 50 + 1)) AS k FROM i)) SELECT fold, count(*) AS n, min(idx) AS first, max(idx) AS last FROM i JOIN f ON idx >= lo AND idx < hi GROUP BY 1")
def _(spark, d):
    rows = R.row_index(daily(spark, d))
    own = V.rows_of_folds(rows, 100, 50)
    return own.groupBy("fold").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("joi10_events_without_bar", f"WITH {CROSS}, e AS (SELECT event_id, symbol, ts + to_days(dayofmonth(ts)::INT) AS ts FROM ev WHERE direction IS NOT NULL) SELECT event_id, b.close FROM e LEFT JOIN bars b ON b.symbol = e.symbol AND b.ts = e.ts", r="close")
def _(spark, d):
    bars = daily(spark, d)
    e = W.crossovers(bars).select("event_id", "symbol", (F.col("ts") + F.make_interval(days=F.dayofmonth("ts"))).alias("ts"))
    return e.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left").select("event_id", "close")


@query("top07_thinned_breaks", f"WITH RECURSIVE b AS (SELECT symbol, row_number() OVER ({BY}) - 1 AS idx, abs(close - {lag('close')}) AS c FROM bars), v AS (SELECT symbol, idx, c, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k FROM b WHERE c > 50), w AS (SELECT symbol, k, idx, c, idx AS anchor, 1 AS g FROM v WHERE k = 1 UNION ALL SELECT v.symbol, v.k, v.idx, v.c, CASE WHEN v.idx - w.anchor >= 10 THEN v.idx ELSE w.anchor END, w.g + (v.idx - w.anchor >= 10)::INT FROM w JOIN v ON v.symbol = w.symbol AND v.k = w.k + 1), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY c DESC, idx) AS rn FROM w) SELECT symbol, idx, c AS confidence FROM r WHERE rn = 1", r="confidence")
def _(spark, d):
    own = R.row_index(daily(spark, d)).select("symbol", "idx", F.abs(F.col("close") - W.previous("close")).alias("confidence")).where("confidence > 50")
    return I.thin_breaks(own, 10)


@query("set03_context_union", "SELECT symbol, count(*) AS n, sum((ts < '1996-06-01')::INT)::BIGINT AS context FROM bars GROUP BY 1")
def _(spark, d):
    bars = daily(spark, d)
    both = B.joined_in_time(bars.where("ts < '1996-06-01'"), bars.where("ts >= '1996-06-01'"))
    return both.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("is_context").alias("context"))


@query("set04_condition_values", f"WITH {CROSS}, e AS (SELECT * FROM ev WHERE direction IS NOT NULL) SELECT DISTINCT 'direction' AS field, direction AS value FROM e UNION ALL SELECT DISTINCT 'weekday', weekday::VARCHAR FROM e UNION ALL SELECT DISTINCT 'symbol', symbol FROM e")
def _(spark, d):
    return N.condition_values(W.crossovers(stored(spark, d, "daily")), ["direction", "weekday", "symbol"])


@query("gra01_relatives", f"WITH {_EDGES} SELECT 'parent' AS side, parent AS node FROM e WHERE child = 'n3' UNION ALL SELECT 'child', child FROM e WHERE parent = 'n3'", use="")
def _(spark, d):
    e = _edges(spark, d)
    return G.parents(e, "n3").select(F.lit("parent").alias("side"), "node").unionByName(G.children(e, "n3").select(F.lit("child").alias("side"), "node"))


@query("gra03_shortest_path", "WITH p AS (SELECT n_regionkey, min('n' || n_nationkey) AS n FROM nation GROUP BY 1) SELECT 'c1>n' || c_nationkey || '>r' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1", use="")
def _(spark, d):
    region = read(spark, d, "customer").where("c_custkey = 1").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    path = G.shortest_path(_edges(spark, d), "c1", f"r{region}")
    return spark.createDataFrame([(">".join(path),)], "path string")


@query("gra04_canonical_order", f"WITH {_EDGES}, n AS (SELECT child AS node FROM e UNION SELECT parent FROM e), r AS (SELECT node, CASE substr(node, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS rank, sha256(node) AS hash FROM n) SELECT rank::INT AS rank, hash, row_number() OVER (PARTITION BY rank ORDER BY hash)::INT AS place FROM r", use="")
def _(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    typed = nodes.select(F.substring("node", 1, 1).alias("type"), F.sha2("node", 256).alias("hash"))
    return G.canonical_order(typed, ["r", "n", "c", "o"]).select("rank", "hash", "place")


@query("gra05_typed_chain", "SELECT r_name, n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", use="")
def _(spark, d):
    e = _edges(spark, d)
    chains = G.typed_chains(e, F.substring("parent", 1, 1), F.substring("child", 1, 1), ["r", "n", "c", "o"])
    key = lambda c: F.substring(c, 2, 20).cast("long")
    named = chains.join(read(spark, d, "region").select(F.col("r_regionkey").alias("_r"), "r_name"), key("r") == F.col("_r")).join(read(spark, d, "nation").select(F.col("n_nationkey").alias("_n"), "n_name"), key("n") == F.col("_n"))
    return named.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"))
