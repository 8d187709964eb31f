"""Rolling and expanding measures over (symbol, ts). A rolling value is null until its frame is full.

Measures take blocks of a series (:mod:`tidemark.operators.blocks`) or plain rows, which they cut into blocks; the
column helpers (``sma``, ``previous`` and so on) are for use inside a measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, as_blocks, base, reads


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where a column does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def rows(w: int) -> WindowSpec:
    return series().rowsBetween(-(w - 1), 0)


def full(value: Column, of: str | Column, w: int) -> Column:
    """``value`` where the last ``w`` rows all have ``of``."""
    return F.when(F.count(of).over(rows(w)) == w, value)


def rolling(f, of: str | Column, w: int) -> Column:
    return full(f(of).over(rows(w)), of, w)


def sma(of: str | Column, w: int) -> Column:
    return rolling(F.avg, of, w)


def previous(of: str | Column, n: int = 1) -> Column:
    return F.lag(of, n).over(series())


def simple_return(of: str = "close", n: int = 1) -> Column:
    base = previous(of, n)
    return F.when(base == 0, 0.0).otherwise(F.col(of) / base - 1)


def log_return(of: str = "close") -> Column:
    base = previous(of)
    return F.when((base > 0) & (F.col(of) > 0), F.log(F.col(of) / base)).when(base.isNotNull(), 0.0)


def log_ratio(of: str = "close") -> Column:
    """Log return; null at the first row and where a price is not positive."""
    base = previous(of)
    return F.when((base > 0) & (F.col(of) > 0), F.log(F.col(of) / base))


@reads(1)
def returns(bars: DataFrame) -> DataFrame:
    return bars.select(*base(bars), (F.col("close") - previous("close")).alias("change"), simple_return().alias("ret"), log_return().alias("log_ret"))


@reads(lambda a: a["w"] - 1)
def rolling_statistics(df: DataFrame, of: str, w: int) -> DataFrame:
    """Mean, sample and population deviation, extremes, z-score and median of the last ``w`` rows."""
    mean, sd = rolling(F.avg, of, w), rolling(F.stddev_samp, of, w)
    return df.select(
        *base(df),
        mean.alias("mean"),
        sd.alias("sd"),
        rolling(F.stddev_pop, of, w).alias("sd_pop"),
        rolling(F.min, of, w).alias("lo"),
        rolling(F.max, of, w).alias("hi"),
        F.when(sd == 0, 0.0).otherwise((F.col(of) - mean) / sd).alias("z"),
        full(F.percentile(F.col(of), F.lit(0.5)).over(rows(w)), of, w).alias("median"),
    )


@reads(lambda a: a["w"] - 1)
def rolled(df: DataFrame, f, of: str, w: int) -> DataFrame:
    """``v``: any aggregate of the last ``w`` values."""
    return df.select(*base(df), rolling(f, of, w).alias("v"))


@reads(lambda a: a["w"] + 1)
def return_volatility(bars: DataFrame, w: int, of: str = "close") -> DataFrame:
    """``v``: sample deviation of the last ``w`` one-step returns, from running sums inside the block less those ``w`` rows
    before: a row costs the same at every ``w``. Returns lie near 0, so that the difference of sums keeps its digits."""
    own = bars.select(*base(bars), simple_return(of).alias("_r"))
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    r, known = F.coalesce("_r", F.lit(0.0)), F.col("_r").isNotNull().cast("int")
    own = own.select(*base(own), F.sum(known).over(so_far).alias("_n"), F.sum(r).over(so_far).alias("_s"), F.sum(r * r).over(so_far).alias("_q"))
    part = lambda c: F.col(c) - F.coalesce(previous(c, w), F.lit(0))
    n, s, q = part("_n"), part("_s"), part("_q")
    return own.select(*base(own), F.when(n == w, F.sqrt(F.greatest((q - s * s / w) / (w - 1), F.lit(0.0)))).alias("v"))


def expanding(df: DataFrame | Blocks, of: str) -> DataFrame:
    """Mean and sample deviation of all values so far: moments of blocks, merged."""
    blocks = as_blocks(df, 0)
    narrow = blocks.extend(lambda d: d.select(*base(d), of)).expanding(of)
    return narrow.own(narrow.frame.select(*base(narrow.frame), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sd")))


@reads(lambda a: a["w"] - 1)
def bands(bars: DataFrame, w: int = 20, width: float = 2.0) -> DataFrame:
    """Moving average, Bollinger bands (population deviation) and Donchian channel."""
    mid, sd = sma("close", w), rolling(F.stddev_pop, "close", w)
    return bars.select(*base(bars), mid.alias("mid"), (mid + width * sd).alias("upper"), (mid - width * sd).alias("lower"), rolling(F.max, "high", w).alias("channel_hi"), rolling(F.min, "low", w).alias("channel_lo"))


def weighted(of: str | Column, w: int) -> Column:
    """Linearly weighted mean, newest heaviest, as a sum of lags: w columns of one sort."""
    return reduce(lambda a, b: a + b, [F.lag(of, k).over(series()) * (w - k) for k in range(w)]) / (w * (w + 1) / 2)


@reads(lambda a: a["w"] - 1)
def wma(df: DataFrame, of: str, w: int, out: str) -> DataFrame:
    return df.select(*base(df), weighted(of, w).alias(out))


@reads(lambda a: a["w"] - 1 + int(a["w"] ** 0.5) - 1)
def hma(df: DataFrame, of: str, w: int, out: str) -> DataFrame:
    """Hull mean: weighted mean over sqrt(w) of twice the half-window mean less the whole-window mean."""
    both = df.select(*base(df), (2 * weighted(of, w // 2) - weighted(of, w)).alias("_diff"))
    return both.select(*base(both), weighted("_diff", int(w**0.5)).alias(out))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(top / bottom)


def volume_flow(bars: DataFrame | Blocks, w: int = 20) -> DataFrame:
    """VWMA and Chaikin money flow over ``w`` rows; cumulative VWAP, on-balance volume and accumulation, whose totals are
    carried from block to block."""
    v = F.col("volume")
    span = F.col("high") - F.col("low")
    multiplier = F.when(span == 0, 0.0).otherwise(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span)
    total = lambda c: rolling(F.sum, c, w)

    def flows(d: DataFrame) -> DataFrame:
        step = previous("close")
        own = d.select(*base(d), "volume", (multiplier * v).alias("_mf"), (F.col("close") * v).alias("_cv"), (typical() * v).alias("_tv"), F.when(F.col("close") > step, v).when(F.col("close") < step, -v).otherwise(0.0).alias("_signed"))
        return own.select("*", ratio(total("_cv"), total("volume")).alias("vwma"), ratio(total("_mf"), total("volume"), 0.0).alias("cmf"))

    reach = max(w - 1, 1)
    own = as_blocks(bars, reach).extend(flows, reach).running({"_pv": "_tv", "_v": "volume", "obv": "_signed", "ad": "_mf"})
    return own.own(own.frame.select(*base(own.frame), "vwma", "cmf", ratio(F.col("_pv"), F.col("_v")).alias("vwap"), "obv", "ad"))


@reads(lambda a: a["w"])
def rolling_mfi(bars: DataFrame, w: int = 14) -> DataFrame:
    """Money flow index from rolling sums of positive and negative flow."""
    own = bars.select(*base(bars), typical().alias("tp"), "volume")
    flow, step = F.col("tp") * F.col("volume"), F.col("tp") - previous("tp")
    own = own.select(*base(own), F.when(step > 0, flow).when(step.isNotNull(), 0.0).alias("up"), F.when(step < 0, flow).when(step.isNotNull(), 0.0).alias("down"))
    up, down = rolling(F.sum, "up", w), rolling(F.sum, "down", w)
    return own.select(*base(own), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)).alias("mfi"))


@reads(lambda a: max(a["n"], a["w"] - 1))
def momentum(bars: DataFrame, n: int = 10, w: int = 20) -> DataFrame:
    before, mean = previous("close", n), sma("close", w)
    return bars.select(*base(bars), (F.when(before == 0, 0.0).otherwise(F.col("close") / before - 1) * 100).alias("roc"), (F.col("close") - before).alias("momentum"), ratio(F.col("close") - mean, mean).alias("distance"))


@reads(lambda a: a["w"] - 1)
def cci(bars: DataFrame, w: int = 20) -> DataFrame:
    own = bars.select(*base(bars), typical().alias("tp"))
    mean, inside = sma("tp", w), F.collect_list("tp").over(rows(w))
    own = own.select(*base(own), "tp", mean.alias("mean"), inside.alias("inside"))
    mad = F.aggregate("inside", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean"))) / w
    return own.select(*base(own), F.when(mad == 0, 0.0).otherwise((F.col("tp") - F.col("mean")) / (0.015 * mad)).alias("cci"))


@reads(lambda a: a["w"] + a["smooth"] + a["signal"] - 3)
def stochastic(bars: DataFrame, w: int = 14, smooth: int = 3, signal: int = 3) -> DataFrame:
    lo, hi = rolling(F.min, "low", w), rolling(F.max, "high", w)
    own = bars.select(*base(bars), F.when(hi == lo, 50.0).otherwise(100 * (F.col("close") - lo) / (hi - lo)).alias("raw"))
    own = own.select(*base(own), sma("raw", smooth).alias("k"))
    return own.select(*base(own), "k", sma("k", signal).alias("d"))


def true_range() -> Column:
    before = previous("close")
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


@reads(lambda a: 2 * a["w"] - 1)
def simple_oscillators(bars: DataFrame, w: int = 14) -> DataFrame:
    """RSI, ATR and ADX from plain rolling means instead of Wilder smoothing."""
    step = F.col("close") - previous("close")
    up, down = F.col("high") - previous("high"), previous("low") - F.col("low")
    own = bars.select(*base(bars), F.greatest(step, F.when(step.isNotNull(), 0.0)).alias("gain"), F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))).alias("loss"), true_range().alias("tr"), F.when(up.isNull(), None).when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"), F.when(up.isNull(), None).when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"))
    gain, loss, atr = sma("gain", w), sma("loss", w), sma("tr", w)
    own = own.select(*base(own), F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)).alias("rsi"), atr.alias("atr"), ratio(100 * sma("plus", w), atr).alias("plus_di"), ratio(100 * sma("minus", w), atr).alias("minus_di"))
    dx = ratio(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"), 0.0)
    own = own.withColumn("dx", dx)
    return own.select(*base(own), "rsi", "atr", "plus_di", "minus_di", sma("dx", w).alias("adx"))


@reads(lambda a: a["slow"] - 1 + a["mid"], lambda a: a["mid"])
def ichimoku(bars: DataFrame, fast: int = 9, mid: int = 26, slow: int = 52) -> DataFrame:
    middle = lambda w: (rolling(F.max, "high", w) + rolling(F.min, "low", w)) / 2
    own = bars.select(*base(bars), "close", middle(fast).alias("conversion"), middle(mid).alias("base"), middle(slow).alias("_slow"))
    return own.select(*base(own), "conversion", "base", previous((F.col("conversion") + F.col("base")) / 2, mid).alias("span_a"), previous("_slow", mid).alias("span_b"), F.lead("close", mid).over(series()).alias("lagging"))


@reads(lambda a: a["w"] - 1)
def rolling_relation(pairs: DataFrame, x: str, y: str, w: int) -> DataFrame:
    """Rolling correlation and covariance of two columns; a window in which one of them does not move has no correlation."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    frame = rows(w)
    moves = lambda c: F.max(c).over(frame) > F.min(c).over(frame)
    r = F.when(moves(x) & moves(y), F.try_divide(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)))
    return pairs.select(*base(pairs), full(r, both, w).alias("corr"), full(F.covar_samp(x, y).over(frame), both, w).alias("covar"))


def stability(rolled: DataFrame) -> DataFrame:
    """Population deviation of the rolling correlation per series, in words."""
    sd = F.stddev_pop("corr")
    return rolled.where(F.col("corr").isNotNull()).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("corr").alias("mean_corr"), sd.alias("sd_corr")).withColumn("label", F.when(F.col("sd_corr") < 0.1, "stable").when(F.col("sd_corr") < 0.2, "slight").otherwise("volatile"))


@reads(lambda a: a["long"] + a["lookback"] - 1)
def volatility_features(bars: DataFrame, short: int = 10, long: int = 30, lookback: int = 60, periods: int = 252) -> DataFrame:
    """Historical volatility, its ratio to a longer one, its rank in the lookback and a regime in words."""
    own = bars.select(*base(bars), log_return().alias("r"))
    own = own.select(*base(own), (rolling(F.stddev_samp, "r", short) * periods**0.5).alias("vol"), (rolling(F.stddev_samp, "r", long) * periods**0.5).alias("long_vol"))
    seen = F.collect_list("vol").over(rows(lookback))
    own = own.select("*", full(seen, "vol", lookback).alias("seen"))
    rank = F.size(F.filter("seen", lambda x: x <= F.col("vol"))) / lookback
    own = own.select(*base(own), "vol", ratio(F.col("vol"), F.col("long_vol")).alias("vol_ratio"), F.when(F.col("seen").isNotNull(), rank).alias("vol_rank"))
    return own.withColumn("regime", F.when(F.col("vol_rank") > 0.8, "high").when(F.col("vol_rank") < 0.2, "low").when(F.col("vol_rank").isNotNull(), "normal"))


@reads(lambda a: max(a["slow"] - 1, a["momentum"], a["long"]))
def trend_state(bars: DataFrame, fast: int = 20, slow: int = 50, momentum: int = 14, short: int = 20, long: int = 60) -> DataFrame:
    """Signs, as doubles: of the fast average over the slow one, of the momentum, and of the short over the long rolling
    population deviation of log returns. Null in the warm-up."""
    sign = lambda a, b: F.when(a > b, 1.0).when(a < b, -1.0).when(a.isNotNull() & b.isNotNull(), 0.0)
    own = bars.select(*base(bars), "close", log_ratio().alias("_r"), sma("close", fast).alias("_f"), sma("close", slow).alias("_s"), (F.col("close") - previous("close", momentum)).alias("_m"))
    own = own.select("*", rolling(F.stddev_pop, "_r", short).alias("_a"), rolling(F.stddev_pop, "_r", long).alias("_b"))
    return own.select(*base(own), sign(F.col("_f"), F.col("_s")).alias("trend_state"), sign(F.col("_m"), F.lit(0.0)).alias("momentum_regime"), sign(F.col("_a"), F.col("_b")).alias("vol_regime"))


@reads(lambda a: a["slow"])
def crosses(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Rows where the fast average crosses the slow one: bullish from below or equal, bearish from above or equal."""
    own = bars.select(*base(bars), "close", sma("close", fast).alias("sma_fast"), sma("close", slow).alias("sma_slow"))
    own = own.withColumn("_gap", F.col("sma_fast") - F.col("sma_slow")).withColumn("_before", previous("_gap"))
    direction = F.when((F.col("_before") <= 0) & (F.col("_gap") > 0), "bullish").when((F.col("_before") >= 0) & (F.col("_gap") < 0), "bearish")
    return own.withColumn("direction", direction).where(F.col("direction").isNotNull()).drop("_gap", "_before")


def crossovers(bars: DataFrame | Blocks, fast: int = 5, slow: int = 20) -> DataFrame:
    """Crossings of the averages as events."""
    event_id = F.concat_ws("|", "symbol", F.unix_timestamp("ts").cast("string"))
    return crosses(bars, fast, slow).select(event_id.alias("event_id"), "symbol", "ts", "direction", F.col("close").alias("price"), "sma_fast", "sma_slow", F.weekday("ts").alias("weekday"))


@reads(lambda a: a["w"] - 1)
def thresholds(df: DataFrame, of: str, w: int = 60, buy: float = 0.7, sell: float = 0.3) -> DataFrame:
    """1 over the rolling upper quantile, -1 under the lower one, else 0, with a confidence: the distance from the
    threshold in shares of what is left up to 1 or down to 0, within [0, 1], and 0.5 without a signal. Missing
    predictions are left out of the result, not of the window."""
    hi, lo = full(F.percentile(F.col(of), F.lit(buy)).over(rows(w)), of, w), full(F.percentile(F.col(of), F.lit(sell)).over(rows(w)), of, w)
    own = df.select(*base(df), of, hi.alias("hi"), lo.alias("lo")).where(F.col(of).isNotNull())
    x, up, down = F.col(of), F.col("hi"), F.col("lo")
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    confidence = F.when(x > up, inside(F.try_divide(x - up, 1.0 - up + 1e-9))).when(x < down, inside(F.try_divide(down - x, down + 1e-9))).otherwise(0.5)
    return own.select(*base(own), F.when(x > up, 1).when(x < down, -1).otherwise(0).alias("signal"), confidence.alias("confidence"), F.col(of).alias("prediction"))


@reads(lambda a: max(a["z"], a["mean"], 2) - 1)
def factor_features(df: DataFrame, of: str, mean: int = 5, z: int = 20) -> DataFrame:
    """One-step return, short mean and population z-score of a factor."""
    m, s = rolling(F.avg, of, z), rolling(F.stddev_pop, of, z)
    return df.select(*base(df), simple_return(of).alias("ret_1"), sma(of, mean).alias("mean"), F.when(s == 0, 0.0).otherwise((F.col(of) - m) / s).alias("z"))


@reads(lambda a: 1 + max([1, *a["lags"]]))
def lag_features(bars: DataFrame, lags: list[int]) -> DataFrame:
    own = bars.select(*base(bars), simple_return().alias("r"), "volume")
    return own.select(*base(own), *[previous("r", k).alias(f"r_lag{k}") for k in lags], (F.col("r") * previous("r")).alias("r_x_lag1"), (F.col("r") * F.col("volume")).alias("r_x_volume"))
