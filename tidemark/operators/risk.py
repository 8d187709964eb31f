"""Risk, performance and drawdowns of return series (symbol, ts, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, as_blocks, base
from tidemark.operators.selection import elements


def win_loss(df: DataFrame, r: str, by: str = "symbol") -> DataFrame:
    """Win and loss rates, mean win and loss, their ratio, the profit factor, and consistency, the share of
    periods above 0 among all; 0 where nothing divides."""
    x = F.col(r)
    own = df.where(x.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg((x < 0).cast("double")).alias("loss_rate"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("mean_loss"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("_up"), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("_down"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return own.select(by, "n", "win_rate", "loss_rate", "mean_win", "mean_loss", safe(F.col("mean_win"), -F.col("mean_loss")).alias("payoff"), safe(F.col("_up"), F.col("_down")).alias("profit_factor"), F.col("win_rate").alias("consistency"))


def ratios(df: DataFrame, r: str, by: str = "symbol", periods: int = 252, free: float = 0.0) -> DataFrame:
    """Sharpe and Sortino ratios (sample deviation; of the negative returns alone for Sortino) and Omega at 0."""
    x = F.col(r)
    own = df.where(x.isNotNull()).groupBy(by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.stddev_samp(F.when(x < 0, x)).alias("down"), F.sum(F.greatest(x, F.lit(0.0))).alias("_up"), F.sum(F.greatest(-x, F.lit(0.0))).alias("_lost"))
    excess = F.col("mean") - free / periods
    safe = lambda a, b: F.when(b.isNull() | (b == 0), 0.0).otherwise(a / b)
    return own.select(by, (safe(excess, F.col("sd")) * periods**0.5).alias("sharpe"), (safe(excess, F.col("down")) * periods**0.5).alias("sortino"), safe(F.col("_up"), F.col("_lost")).alias("omega"))


def tail_risk(df: DataFrame, r: str, by: str = "symbol", alpha: float = 0.05) -> DataFrame:
    """Historical value at risk, the element int(alpha n) of the ascending returns with its sign turned, and the mean of
    the int(alpha n) + 1 lowest. The element is selected, not ranked."""
    own = df.where(F.col(r).isNotNull()).select(by, r)
    limit = elements(own, r, {"_limit": F.floor(F.lit(alpha) * F.col("n"))}, by).select(by, "_limit", (F.floor(F.lit(alpha) * F.col("n")) + 1).alias("_k"))
    # rows that tie with the limit fill the tail up to its size
    below = own.join(limit, by).groupBy(by).agg(F.max("_limit").alias("_limit"), F.max("_k").alias("_k"), F.count_if(F.col(r) < F.col("_limit")).alias("_n"), F.coalesce(F.sum(F.when(F.col(r) < F.col("_limit"), F.col(r))), F.lit(0.0)).alias("_s"))
    return below.select(by, (-F.col("_limit")).alias("var"), (-(F.col("_s") + F.col("_limit") * (F.col("_k") - F.col("_n"))) / F.col("_k")).alias("expected_shortfall"))


def benchmark(df: DataFrame, r: str, m: str, by: str = "symbol", periods: int = 252) -> DataFrame:
    """Beta, alpha per period, Treynor and information ratio against a benchmark return."""
    active = F.col(r) - F.col(m)
    own = df.where(F.col(r).isNotNull() & F.col(m).isNotNull()).groupBy(by).agg((F.covar_samp(r, m) / F.var_samp(m)).alias("beta"), F.avg(r).alias("_r"), F.avg(m).alias("_m"), F.avg(active).alias("_a"), F.stddev_samp(active).alias("_s"), F.count("*").alias("n"))
    return own.select(by, "n", "beta", (F.col("_r") - F.col("beta") * F.col("_m")).alias("alpha"), F.when(F.col("beta") != 0, F.col("_r") * periods / F.col("beta")).alias("treynor"), F.when(F.col("_s") > 0, F.col("_a") / F.col("_s") * periods**0.5).alias("information"))


def calmar(df: DataFrame | Blocks, r: str, equity: str, periods: int = 252) -> DataFrame:
    """Annual mean return over the greatest drawdown of the equity; 0 where there is none."""
    rows = df.rows() if isinstance(df, Blocks) else df
    mean = rows.where(F.col(r).isNotNull()).groupBy("symbol").agg(F.avg(r).alias("_m"))
    worst = drawdowns(df, equity).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))
    return mean.join(worst, "symbol").select("symbol", "max_drawdown", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.col("_m") * periods / F.abs("max_drawdown")).alias("calmar"))


def drawdowns(df: DataFrame | Blocks, equity: str) -> DataFrame:
    """Running peak, relative drawdown, and the number of the episode: an episode begins at each new peak."""
    own = as_blocks(df, 0).extend(lambda d: d.select(*base(d), F.col(equity).alias("equity"))).running({"peak": "equity"}, F.max)
    own = own.running({"episode": (F.col("equity") == F.col("peak")).cast("int")})
    return own.own(own.frame.select(*base(own.frame), "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown"), "episode"))


def episodes(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Closed episodes with a loss, and the open one at the end even without: depth, rows under water, and the rows from
    the peak until it is passed again (to the end of the series for the open one)."""
    own = df.groupBy(by, "episode").agg(F.min("drawdown").alias("depth"), (F.count("*") - 1).alias("length"))
    last = own.groupBy(by).agg(F.max("episode").alias("_last"))
    own = own.join(last, by).withColumn("is_open", F.col("episode") == F.col("_last")).drop("_last")
    return own.where((F.col("depth") < 0) | F.col("is_open")).withColumn("recovery", F.col("length") + 1)


def drawdown_statistics(found: DataFrame, by: str = "symbol") -> DataFrame:
    """Depths, lengths and recoveries of all episodes under water of a series."""
    under = found.where("length > 0")
    return under.groupBy(by).agg(F.count("*").alias("n"), F.min("depth").alias("max_drawdown"), F.avg("depth").alias("mean_drawdown"), F.avg("recovery").alias("mean_recovery"), F.max("recovery").alias("longest_recovery"), F.min("recovery").alias("shortest_recovery"), F.count_if("is_open").alias("open"))


def inverse_risk(df: DataFrame, r: str, by: str = "symbol") -> DataFrame:
    """Weights in proportion to one over the deviation of the returns; series that do not vary get none."""
    own = df.where(F.col(r).isNotNull()).groupBy(by).agg(F.stddev_samp(r).alias("volatility"), F.count("*").alias("n")).where("n > 1 and volatility > 0")
    total = own.agg(F.sum(1 / F.col("volatility")).alias("_t"))  # one row
    return own.crossJoin(F.broadcast(total)).select(by, "volatility", (1 / F.col("volatility") / F.col("_t")).alias("weight"))


def portfolio(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Return of a weighted portfolio per time."""
    return returns.join(weights, "symbol").groupBy("ts").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count("r").alias("n"))


def risk_contributions(covariance: DataFrame, weights: DataFrame) -> DataFrame:
    """Euler shares of the portfolio variance from a long covariance table (a, b, covar), both orders present."""
    wa, wb = weights.select(F.col("symbol").alias("a"), F.col("w").alias("wa")), weights.select(F.col("symbol").alias("b"), F.col("w").alias("wb"))
    part = covariance.join(wa, "a").join(wb, "b").groupBy("a").agg(F.sum(F.col("wa") * F.col("wb") * F.col("covar")).alias("part"))
    total = F.sum("part").over(Window.partitionBy(F.lit(0)))
    return part.select(F.col("a").alias("symbol"), "part", (F.col("part") / total).alias("share"), total.alias("variance"))


def exposure(positions: DataFrame, by: str) -> DataFrame:
    x = F.col("value")
    long, short = F.sum(F.greatest(x, F.lit(0.0))), F.sum(F.least(x, F.lit(0.0)))
    return positions.groupBy(by).agg(long.alias("long"), short.alias("short"), (long - short).alias("gross"), (long + short).alias("net"))
