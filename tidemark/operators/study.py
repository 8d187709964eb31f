"""Smaller jobs around events, conditions, portfolios and feature studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.laws import binomial_tail
from tidemark.operators.blocks import Blocks, base, reads
from tidemark.operators.quality import neighbours
from tidemark.operators.windows import corr, series


def quote_metrics(quotes: DataFrame) -> DataFrame:
    mid, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    return quotes.withColumns({"mid": mid, "spread": spread, "spread_bps": F.when(mid != 0, spread / mid * 10000)})


def condition(df: DataFrame, spec: dict) -> Column:
    """All fields equal their values; a field that the frame lacks matches nothing."""
    if any(k not in df.columns for k in spec):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(k) == v, F.lit(False)) for k, v in spec.items()], F.lit(True))


def matching(df: DataFrame, spec: dict) -> DataFrame:
    return df.where(condition(df, spec))


def matched_names(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Each row once for every condition it meets: all conditions in one scan."""
    names = F.array_compact(F.array(*[F.when(condition(df, spec), F.lit(name)) for name, spec in specs.items()]))
    return df.withColumn("name", F.explode(names))


def valid_from(df: DataFrame, lags: DataFrame) -> DataFrame:
    """When a value may be used: the later of its event and its release plus the factor's lag in days (small table)."""
    return df.join(F.broadcast(lags), "factor").withColumn("valid_from", F.greatest("event_ts", F.col("release_ts") + F.make_interval(days=F.col("days"))))


def dataset_statistics(bars: DataFrame | Blocks, seconds: int) -> DataFrame:
    """Rows, repeated times, gaps, expected rows between first and last, missing rows and their share in percent, mean
    spread (null without a column ``spread``) and volume, days with rows, and their share of all days of the span."""
    columns = bars.frame.columns if isinstance(bars, Blocks) else bars.columns
    spread = F.col("spread") if "spread" in columns else F.lit(None).cast("double")
    own = neighbours(bars, "volume", spread.alias("spread")).select("symbol", "ts", "volume", "spread", (F.unix_timestamp("ts") - F.unix_timestamp("before")).alias("_d"))
    expected = F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / seconds) + 1
    got = own.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("_d") == 0).alias("duplicates"), F.count_if(F.col("_d") > seconds).alias("gaps"), expected.alias("expected"), F.avg("spread").alias("mean_spread"), F.avg("volume").alias("mean_volume"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("_span"))
    # days are told apart before they are counted, so that no group gathers a set
    days = own.select("symbol", F.to_date("ts").alias("_day")).distinct().groupBy("symbol").agg(F.count("*").alias("trading_days"))
    missing = F.greatest(F.col("expected") - F.col("n"), F.lit(0))
    return got.join(days, "symbol").select("symbol", "n", "duplicates", "gaps", "expected", missing.alias("missing"), F.least(F.lit(100.0), missing * 100.0 / F.col("expected")).alias("missing_percent"), (F.col("n") * 100.0 / F.col("expected")).alias("completeness"), "mean_spread", "mean_volume", "trading_days", (F.col("trading_days") * 100.0 / F.col("_span")).alias("daily_coverage"))


def blended(prior: DataFrame, seen: DataFrame, alpha: float) -> DataFrame:
    """alpha x the observed transition probabilities plus the rest of the prior ones."""
    return prior.join(seen, ["from", "to"], "left").select("from", "to", (alpha * F.coalesce("p", F.lit(0.0)) + (1 - alpha) * F.col("prior")).alias("p"))


def outcome_counts(df: DataFrame, r: str, by: str) -> DataFrame:
    x = F.col(r)
    return df.where(x.isNotNull()).groupBy(by).agg(F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("flat"), F.avg((x > 0).cast("double")).alias("ratio"), F.avg(x).alias("mean"))


def yield_curve(df: DataFrame) -> DataFrame:
    """Per day, from (day, tenor in years, yield) with one yield a tenor: level (longest tenor), least-squares slope
    over the tenors, curvature (shortest + longest - 2 x middle), and the benchmark spreads, null where a tenor is
    missing. Fewer than three tenors give 0 for the first three; equal tenors a slope of 0."""
    x, y = F.col("tenor"), F.col("yield")
    at = lambda t: F.max(F.when(F.abs(x - t) < 1e-9, y))
    own = df.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("tenor", "yield"))).alias("_c"), F.covar_pop(x, y).alias("_xy"), F.var_pop(x).alias("_xx"), at(10.0).alias("_10"), at(2.0).alias("_2"), at(30.0).alias("_30"), at(0.25).alias("_3m"))
    n = F.size("_c")
    take = lambda i: F.element_at("_c", i)["yield"]
    some = lambda c: F.when(n < 3, 0.0).otherwise(c)
    middle = take((F.floor(n / 2) + 1).cast("int"))
    return own.select("day", some(take(F.lit(-1))).alias("level"), some(F.coalesce(F.try_divide("_xy", "_xx"), F.lit(0.0))).alias("slope"), some(take(F.lit(1)) + take(F.lit(-1)) - 2 * middle).alias("curvature"), (F.col("_10") - F.col("_2")).alias("spread_10y_2y"), (F.col("_30") - F.col("_10")).alias("spread_30y_10y"), (F.col("_10") - F.col("_3m")).alias("spread_10y_3m"))


def latest_ratios(bars: DataFrame) -> DataFrame:
    """Ratio of the last closes of each pair of symbols (one row per symbol meets the others)."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    other = last.select(F.col("symbol").alias("b"), F.col("close").alias("_c"))
    return last.join(other, F.col("symbol") < F.col("b")).select(F.col("symbol").alias("a"), "b", (F.col("close") / F.col("_c")).alias("ratio"))


def ledger(df: DataFrame, warm_up: int, horizon: int) -> DataFrame:
    """Per source: rows, days, repeated times, days common to all sources, days it has besides, and the common days
    left after the features' warm-up and the label's horizon."""
    own = df.groupBy("source", "ts").agg(F.count("*").alias("_c"), F.to_date(F.min("ts")).alias("_day"))
    rows = own.groupBy("source").agg(F.sum("_c").alias("n"), F.countDistinct("_day").alias("days"), F.sum(F.col("_c") - 1).alias("duplicates"))
    sources = df.select("source").distinct().agg(F.count("*").alias("_k"))
    common = own.select("source", "_day").distinct().groupBy("_day").agg(F.count("*").alias("_n")).join(F.broadcast(sources)).agg(F.count_if(F.col("_n") == F.col("_k")).alias("common"))
    usable = F.greatest(F.greatest(F.col("common") - warm_up, F.lit(0)) - horizon, F.lit(0))
    return rows.join(F.broadcast(common)).select("source", "n", "days", "duplicates", "common", (F.col("days") - F.col("common")).alias("besides"), usable.alias("usable"))


def evidence(items: DataFrame, weights: DataFrame, default: float = 0.2) -> DataFrame:
    """Per context: strength x item weight x source weight by direction, over the greatest of the three (0.001 at
    least), the score (bullish less bearish within [-1, 1]), and the mean over sources of their greatest confidence.

    ``items``: context, source, direction (Bullish, Bearish, Neutral), strength, weight, confidence; ``weights``: source,
    source_weight (a small table; other sources weigh ``default``).
    """
    value = F.coalesce("source_weight", F.lit(default)) * F.col("strength") * F.col("weight")
    own = items.join(F.broadcast(weights), "source", "left").withColumn("_v", value)
    part = lambda d: F.sum(F.when(F.col("direction") == d, F.col("_v")).otherwise(0.0)).alias(d)
    by_source = own.groupBy("context", "source").agg(part("Bullish"), part("Bearish"), part("Neutral"), F.max("confidence").alias("_c"))
    total = by_source.groupBy("context").agg(F.sum("Bullish").alias("_u"), F.sum("Bearish").alias("_d"), F.sum("Neutral").alias("_n"), F.avg("_c").alias("confidence"))
    most = F.greatest("_u", "_d", "_n", F.lit(0.001))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_u") - F.col("_d")))
    return total.select("context", (F.col("_u") / most).alias("bullish"), (F.col("_d") / most).alias("bearish"), (F.col("_n") / most).alias("neutral"), score.alias("score"), "confidence")


def target_correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    row = df.agg(*[corr(target, c).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("corr")) for c in columns])))


def account_limits(trades: DataFrame, daily: float = 5.0, total: float = 10.0, risk: float = 1.0) -> DataFrame:
    """Limits in percent per trade (account, trade, ts, initial, balance, risk_amount, reward_amount): the day's lowest
    balance and the current one against the initial balance, the amount at risk against the current one, and a reward of
    at least twice the risk."""
    low = F.min("balance").over(Window.partitionBy("account", F.to_date("ts")))
    own = trades.select("*", (F.try_divide(F.col("initial") - low, F.col("initial")) * 100).alias("daily_dd"), (F.try_divide(F.col("initial") - F.col("balance"), F.col("initial")) * 100).alias("total_dd"), (F.try_divide("risk_amount", "balance") * 100).alias("risk_pct"), F.when(F.col("risk_amount") > 0, F.col("reward_amount") / F.col("risk_amount")).otherwise(0.0).alias("rr"))
    passed = {"daily_ok": F.col("daily_dd") <= daily, "total_ok": F.col("total_dd") <= total, "risk_ok": F.col("risk_pct") <= risk, "rr_ok": F.col("rr") >= 2}
    return own.select("account", "trade", "daily_dd", "total_dd", "risk_pct", "rr", *[c.alias(n) for n, c in passed.items()], reduce(lambda a, b: a & b, passed.values()).alias("valid"))


def runs(df: DataFrame, state: str, r: str) -> DataFrame:
    """Contiguous runs of one state with their compounded return."""
    new = F.when(F.lag(state).over(series()).eqNullSafe(F.col(state)), 0).otherwise(1)
    own = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("symbol", "run").agg(F.first(state).alias("state"), F.min("ts").alias("start"), F.count("*").alias("length"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total"))


@reads(lambda a: a["w"])
def _channel(bars: DataFrame, w: int) -> DataFrame:
    before = series().rowsBetween(-w, -1)
    return bars.select(*base(bars), "close", F.max("high").over(before).alias("_hi"), F.min("low").over(before).alias("_lo"), F.count("*").over(before).alias("_k")).where(F.col("_k") == w)


def breakouts(bars: DataFrame | Blocks, w: int) -> DataFrame:
    """Share of closes above the highest high, and below the lowest low, of the ``w`` rows before."""
    own = _channel(bars, w)
    return own.groupBy("symbol").agg(F.avg((F.col("close") > F.col("_hi")).cast("double")).alias("up"), F.avg((F.col("close") < F.col("_lo")).cast("double")).alias("down"), F.count("*").alias("n"))


@reads(0, lambda a: 2 * a["w"] - 1)
def _halves(df: DataFrame, r: str, w: int) -> DataFrame:
    """Sums of the next ``w`` returns and of the ``w`` after those, as far as there are any."""
    ahead = series().rowsBetween(w, 2 * w - 1)
    return df.select(*base(df), F.sum(r).over(series().rowsBetween(0, w - 1)).alias("_a"), F.sum(r).over(ahead).alias("_b")).where("_b is not null")


def trend_persistence(df: DataFrame | Blocks, r: str, w: int = 10) -> DataFrame:
    """Of the places where a window's return and the next one's both differ from 0: the share with the same sign, and the
    share with the opposite one."""
    same = F.count_if(F.col("_a") * F.col("_b") > 0)
    turned = F.count_if(F.col("_a") * F.col("_b") < 0)
    own = _halves(df, r, w).groupBy("symbol").agg(same.alias("_s"), turned.alias("_t"))
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("_s") + F.col("_t")), F.lit(0.0))
    return own.select("symbol", part("_s").alias("persistence"), part("_t").alias("reversal"))


@reads(0, lambda a: a["w"] + 1)
def _moves(df: DataFrame, r: str, w: int) -> DataFrame:
    """Sums of the next ``w`` returns and the return after them, where one more follows."""
    ahead = lambda k: F.lead(r, k).over(series())
    return df.select(*base(df), F.sum(r).over(series().rowsBetween(0, w - 1)).alias("_m"), ahead(w).alias("_n"), ahead(w + 1).alias("_z")).where("_z is not null")


def mean_reversion(df: DataFrame | Blocks, r: str, w: int = 5) -> DataFrame:
    """Share of moves over ``w`` rows that the next return turns against, among those and the other moves beyond 0.001."""
    turned = F.col("_m") * F.col("_n") < 0
    own = _moves(df, r, w).groupBy("symbol").agg(F.count_if(turned).alias("_t"), F.count_if(turned | (F.abs("_m") > 0.001)).alias("_n"))
    return own.select("symbol", F.coalesce(F.try_divide(F.col("_t").cast("double"), F.col("_n")), F.lit(0.0)).alias("mean_reversion"))


def votes(df: DataFrame, flags: list[Column], least: int) -> DataFrame:
    count = sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    return df.withColumn("votes", count).select("symbol", "ts", "votes", F.when(F.col("votes") >= least, "BUY").otherwise("HOLD").alias("signal"))


def best(df: DataFrame, by: str) -> DataFrame:
    """Best row per group by (score, n) falling and name rising."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("n"), "name")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def position_size(df: DataFrame, target: float = 0.15, limit: float = 0.10, leverage: float = 3.0) -> DataFrame:
    """Target over current volatility, at most ``leverage``, 0 without a prediction or volatility, then shrunk from 80 %
    of the worst drawdown allowed to 0 at the limit; the worst drawdown so far counts, not the current one. The sign of
    the prediction turns up twice in the rule, so sizes are never negative.

    ``df``: symbol, ts, prediction, volatility, equity."""
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    own = df.select("*", F.try_divide(F.max("equity").over(so_far) - F.col("equity"), F.max("equity").over(so_far)).alias("_dd"))
    own = own.withColumn("_worst", F.max("_dd").over(so_far))
    scale = F.when(F.col("_worst") >= limit, 0.0).when(F.col("_worst") >= 0.8 * limit, F.greatest(F.lit(0.0), 1 - (F.col("_worst") - 0.8 * limit) / (0.2 * limit))).otherwise(1.0)
    missing = F.col("volatility").isNull() | F.col("prediction").isNull()
    size = F.when(missing, None).when((F.col("volatility") <= 1e-9) | (F.col("prediction") == 0), 0.0).otherwise(F.least(F.try_divide(F.lit(target), F.col("volatility")), F.lit(leverage)))
    return own.select("symbol", "ts", (size * scale).alias("size"))


def feature_sweep(df: DataFrame, features: list[str], outcome: str, alpha: float = 0.05) -> DataFrame:
    """Each feature by itself: outcomes and the share above zero on either side of 0, the exact two-sided p-value of as
    many rises and falls, and whether it holds for all tests of the sweep together (Bonferroni): one aggregate."""
    long = df.where(F.col(outcome).isNotNull()).select(outcome, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]))).where("x is not null")
    up, down = F.count_if(F.col(outcome) > 0), F.count_if(F.col(outcome) < 0)
    own = long.groupBy("feature", (F.col("x") > 0).alias("side")).agg(F.count(outcome).alias("n"), F.avg((F.col(outcome) > 0).cast("double")).alias("p_up"), up.alias("_u"), down.alias("_d"))
    n = F.col("_u") + F.col("_d")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, F.greatest("_u", "_d"))))
    return own.select("feature", "side", "n", "p_up", p.alias("p"), (p * (2 * len(features)) < alpha).alias("significant"))


def binned_probabilities(train: DataFrame, test: DataFrame, x: str, y: str, bins: int, by: str = "symbol") -> DataFrame:
    """Share of y = 1 by equal-width bin of the training range, given to the test rows; rows of empty bins fall out."""
    ends = train.groupBy(by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).cast("int")
    table = train.join(ends, by).groupBy(by, place.alias("_bin")).agg(F.avg(F.col(y).cast("double")).alias("p"))
    return test.join(ends, by).withColumn("_bin", place).join(table, [by, "_bin"]).drop("_lo", "_hi", "_bin")


def revisions(df: DataFrame, as_of: int) -> DataFrame:
    """Latest revision of each object, its payload, and the payload as of a revision number."""
    return df.groupBy("object").agg(F.max("revision").alias("latest"), F.max_by("payload", "revision").alias("payload"), F.max_by(F.when(F.col("revision") <= as_of, F.col("payload")), F.when(F.col("revision") <= as_of, F.col("revision"))).alias(f"as_of_{as_of}"))


def coverage(seen: DataFrame, days: DataFrame, sources: DataFrame) -> DataFrame:
    """How many of the days each source lacks; the grid is days x sources, both small calendars."""
    grid = days.distinct().withColumn("_k", F.lit(1)).join(sources.distinct().withColumn("_k", F.lit(1)), "_k").drop("_k")
    return grid.join(seen.distinct(), ["source", "day"], "left_anti").groupBy("source").agg(F.count("*").alias("lacking"))
