"""Forward labels: bar-count returns, classes, triple barriers, and calendar-day outcomes of events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, range_extremes
from tidemark.operators.blocks import Blocks, as_blocks, base, cut, reads
from tidemark.operators.windows import rolling, series, simple_return

#: Seconds of the clock buckets in which events look for their ends.
YEAR = 366 * 86400


@reads(lambda a: a["w"], lambda a: a["horizon"])
def forward_labels(bars: DataFrame, horizon: int, band: float = 0.02, w: int = 20) -> DataFrame:
    """Return over the next ``horizon`` bars, its sign, its class by a band, and it over the recent deviation."""
    ahead = F.lead("close", horizon).over(series()) / F.col("close") - 1
    own = bars.select(*base(bars), "close", ahead.alias("fwd"), simple_return().alias("_r"))
    sd = rolling(F.stddev_samp, "_r", w)
    return own.select(*base(own), "fwd", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("int")).alias("up"), F.when(F.col("fwd") > band, 1).when(F.col("fwd") < -band, -1).when(F.col("fwd").isNotNull(), 0).alias("class"), F.when(sd > 0, F.col("fwd") / sd).alias("vol_adjusted"))


@reads(0, lambda a: a["horizon"])
def triple_barrier(bars: DataFrame, take: float, stop: float, horizon: int) -> DataFrame:
    """1 if the take-profit is met first within ``horizon`` bars, -1 if the stop is, else 0; null for the last bars."""
    ahead = F.collect_list("close").over(series().rowsBetween(1, horizon))
    own = bars.select(*base(bars), "close", ahead.alias("ahead"))
    moves = F.transform("ahead", lambda x: x / F.col("close") - 1)
    hit = F.filter(moves, lambda m: (m >= take) | (m <= -stop))
    return own.where(F.size("ahead") == horizon).select(*base(own), F.when(F.size(hit) == 0, 0).when(F.element_at(hit, 1) >= take, 1).otherwise(-1).alias("label"))


@reads(0, lambda a: a["horizon"])
def bar_outcomes(bars: DataFrame, horizon: int, cost: float) -> DataFrame:
    """Outcome of entering at each close: forward return, best and worst excursion, and net of the cost of both sides."""
    frame = series().rowsBetween(1, horizon)
    full = F.count("*").over(frame) == horizon
    ret = F.lead("close", horizon).over(series()) / F.col("close") - 1
    return bars.select(*base(bars), F.when(full, ret).alias("ret"), F.when(full, F.max("high").over(frame) / F.col("close") - 1).alias("mfe"), F.when(full, F.min("low").over(frame) / F.col("close") - 1).alias("mae"), F.when(full, ret - 2 * cost).alias("net"), F.when(full, (ret - 2 * cost > 0).cast("int")).alias("win"))


def outcomes(events: DataFrame, bars: DataFrame, horizons: list[int], threshold: float = 0.01) -> DataFrame:
    """Outcome of each event at each horizon in calendar days.

    The end is the first bar at or after event + horizon; without one all outcome columns are null. The sign of a
    bearish event's return is turned, its favourable excursion is downwards. Excursions look at bars after the event
    up to the end.
    """
    asked = events.select("event_id", "symbol", "ts", "direction", "price", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_days"))
    asked = asked.withColumn("target", F.col("ts") + F.make_interval(days=F.col("horizon_days")))
    ended = as_of(asked, bars, ["close"], at="target", forward=True, width=YEAR).withColumn("span_id", F.concat_ws("#", "event_id", F.col("horizon_days").cast("string")))
    spans = ended.select("span_id", "symbol", F.col("ts").alias("start"), F.col("asof_ts").alias("stop"))
    own = ended.join(range_extremes(spans, bars), "span_id", "left")
    sign = F.when(F.col("direction") == "bearish", -1.0).otherwise(1.0)
    raw, up, down = F.col("asof_close") / F.col("price") - 1, F.col("highest") / F.col("price") - 1, F.col("lowest") / F.col("price") - 1
    mfe = F.when(F.col("direction") == "bearish", -down).otherwise(up)
    mae = F.when(F.col("direction") == "bearish", -up).otherwise(down)
    return own.select("event_id", "symbol", "ts", "direction", "horizon_days", F.col("asof_ts").alias("realized_end"), (raw * sign).alias("ret"), mfe.alias("mfe"), mae.alias("mae"), (raw * sign >= threshold).alias("hit"))


def round_trips(signals: DataFrame) -> Blocks:
    """Signals (symbol, ts, price, action) as round trips, in blocks: a BUY after another action, or the first, opens a
    trade; the next SELL closes it. What is open at the end of a block closes with the first SELL of a later one, from
    a table with one row a block; an open trade at the end of the series has no exit."""
    acts = cut(signals.where(F.col("action").isin("BUY", "SELL")).select("symbol", "ts", "price", "action"), 1, keep=True)
    sell = F.when(F.col("action") == "SELL", F.struct("ts", "price"))
    after = series().rowsBetween(1, Window.unboundedFollowing)
    own = acts.frame.select(*base(acts.frame), "price", "action", F.lag("action").over(series()).alias("_before"), F.first(F.when(acts.inside(), sell), True).over(after).alias("_own"))
    firsts = acts.frame.where(acts.inside()).groupBy("symbol", "__name", "__block").agg(F.min_by(sell, F.when(F.col("action") == "SELL", F.col("ts"))).alias("_sell"))
    later = Window.partitionBy("__name").orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("symbol", F.first("_sell", True).over(later).alias("_later"))
    opened = own.where((F.col("action") == "BUY") & ~F.col("action").eqNullSafe(F.col("_before"))).join(firsts, "symbol").withColumn("_exit", F.coalesce("_own", "_later"))
    return replace(acts, frame=opened.select(*base(opened), F.col("price").alias("entry"), F.col("_exit")["ts"].alias("exit_ts"), F.col("_exit")["price"].alias("exit")), back=0)


def first_of_runs(signals: DataFrame) -> DataFrame:
    """Signals (symbol, ts, price, action) as round trips: BUY only when flat, SELL only when long; a leading SELL is
    dropped, runs of one action count once, and an open trade is closed at the last price."""
    return closed_at_end(round_trips(signals).rows(), signals)


def closed_at_end(trades: DataFrame, signals: DataFrame) -> DataFrame:
    last = signals.groupBy("symbol").agg(F.max("ts").alias("end_ts"), F.max_by("price", "ts").alias("end_price"))
    return trades.join(last, "symbol").select("symbol", F.col("ts").alias("entry_ts"), "entry", F.coalesce("exit_ts", "end_ts").alias("exit_ts"), F.coalesce("exit", "end_price").alias("exit"))


def trade_summary(trades: DataFrame, cost: float, by: str = "symbol", periods: int = 252) -> DataFrame:
    """Trades, mean, total and best profit per trade after cost on both sides, win rate, annualised Sharpe ratio of the
    profits (population deviation, 0 for a single trade)."""
    own = trades.withColumn("pnl", (F.col("exit") * (1 - cost) - F.col("entry")) / F.col("entry"))
    sharpe = F.when(F.count("*") > 1, F.avg("pnl") / (F.stddev_pop("pnl") + 1e-8) * periods**0.5).otherwise(0.0)
    return own.groupBy(by).agg(F.count("*").alias("trades"), F.avg("pnl").alias("mean"), F.sum("pnl").alias("total"), F.max("pnl").alias("best"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), sharpe.alias("sharpe"))


def trade_drawdown(trades: DataFrame, cost: float) -> DataFrame:
    """Greatest drawdown per symbol of one unit that is compounded trade by trade, in order of the exits."""
    pnl = (F.col("exit") * (1 - cost) - F.col("entry")) / F.col("entry")
    own = trades.select("symbol", F.col("exit_ts").alias("ts"), F.log1p(F.greatest(pnl, F.lit(-1 + 1e-12))).alias("_g"))
    path = as_blocks(own, 0).running({"_equity": "_g"}).running({"_peak": F.greatest("_equity", F.lit(0.0))}, F.max)
    return path.own(path.frame.select(*base(path.frame), (F.exp(F.col("_equity") - F.col("_peak")) - 1).alias("_dd"))).groupBy("symbol").agg(F.min("_dd").alias("max_drawdown"))


def contract(events: DataFrame, bars: DataFrame, horizon_days: int = 1, threshold: float = 0.0) -> DataFrame:
    """The fixed label of a study: whether the direction-aware close-to-close return after ``horizon_days`` is at least
    ``threshold``; null without a bar at the end. Per event: event_id, realized_end, hit_threshold_<n>d."""
    if horizon_days < 1 or threshold < 0:
        raise ValueError("the horizon must be at least one day, the threshold not negative")
    own = outcomes(events, bars, [horizon_days], threshold)
    return own.select("event_id", "realized_end", F.col("hit").cast("int").alias(f"hit_threshold_{horizon_days}d"))
