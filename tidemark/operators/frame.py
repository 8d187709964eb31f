"""The feature frame of a bar series, its warm-up, and small strategies over bars."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.laws import critical
from tidemark.operators import windows as W
from tidemark.operators.blocks import Blocks, as_blocks, base, reads
from tidemark.operators.recursive import macd_lines
from tidemark.operators.scan import row_index

#: Names of the frame, in order.
FEATURES = (
    "returns", "log_returns", "rolling_mean_20", "rolling_std_20", "momentum_14", "rate_of_change_14", "rsi_14", "macd_hist", "atr_14", "bb_pct_b",
    "stoch_k", "cci_20", "mfi_14", "vwap", "hist_vol_20", "vol_ratio", "trend_state", "vol_regime", "momentum_regime",
)


def feature_frame(bars: DataFrame | Blocks, drop_missing: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, ts and the features of each bar, null in their warm-up; ``drop_missing`` leaves those rows out.

    Oscillators and true range are plain rolling means here, deviations those of the population, and the true range
    starts at the second bar. All rolling columns share one sort over blocks that reach 61 rows back; the recursive pass is
    that of MACD, and the totals of the average price are carried from block to block.
    """
    blocks = as_blocks(bars, 61)
    blocks = blocks.extend(lambda d: d.select(*base(d), "open", "high", "low", "close", "volume", *keep))
    blocks = macd_lines(blocks)
    blocks = blocks.extend(lambda d: _rolling_features(d, keep), 61).running({"_pv": "_flow", "_v": "volume"})
    out = blocks.own(blocks.frame.withColumn("vwap", F.try_divide("_pv", "_v")).select(*base(blocks.frame), *keep, *FEATURES))
    return out.na.drop(subset=list(FEATURES)) if drop_missing else out


def _rolling_features(own: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """All features but the cumulative one, and the flows that it adds up."""
    close, before = F.col("close"), W.previous("close")
    step = close - before
    typical = W.typical()
    own = own.select(
        *base(own), "close", "high", "low", "volume", *keep,
        F.when(before != 0, step / before).alias("returns"), W.log_ratio().alias("log_returns"), (F.col("fast") - F.col("slow") - F.col("signal")).alias("macd_hist"),
        F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))).alias("_gain"), F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))).alias("_loss"),
        F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))).alias("_tr"),
        typical.alias("_tp"), W.previous(typical).alias("_tp0"), (close - W.previous("close", 14)).alias("momentum_14"), W.previous("close", 14).alias("_base"),
    )
    flow = F.col("_tp") * F.col("volume")
    up, down = F.when(F.col("_tp0").isNotNull(), F.when(F.col("_tp") > F.col("_tp0"), flow).otherwise(0.0)), F.when(F.col("_tp0").isNotNull(), F.when(F.col("_tp") < F.col("_tp0"), flow).otherwise(0.0))
    roll = W.rolling
    own = own.select(
        "*", up.alias("_up"), down.alias("_down"), roll(F.avg, "close", 20).alias("rolling_mean_20"), roll(F.stddev_pop, "close", 20).alias("rolling_std_20"), roll(F.avg, "_gain", 14).alias("_g"), roll(F.avg, "_loss", 14).alias("_l"),
        roll(F.avg, "_tr", 14).alias("atr_14"), roll(F.max, "high", 14).alias("_hh"), roll(F.min, "low", 14).alias("_ll"), roll(F.avg, "_tp", 20).alias("_mid"), F.collect_list("_tp").over(W.rows(20)).alias("_in"),
        flow.alias("_flow"), roll(F.stddev_pop, "log_returns", 20).alias("hist_vol_20"), roll(F.stddev_pop, "log_returns", 60).alias("_hv60"),
        roll(F.stddev_pop, "returns", 10).alias("_v10"), roll(F.stddev_pop, "returns", 30).alias("_v30"), roll(F.avg, "close", 50).alias("_m50"),
    )
    own = own.select("*", roll(F.sum, "_up", 14).alias("_pos"), roll(F.sum, "_down", 14).alias("_neg"))
    sign = lambda a, b: F.when(a > b, 1.0).when(a < b, -1.0).when(a.isNotNull() & b.isNotNull(), 0.0)
    deviation = F.aggregate("_in", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mid"))) / 20
    oscillator = lambda top, bottom: F.when(bottom == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(top, bottom)))
    span = F.col("_hh") - F.col("_ll")
    columns = {
        "rate_of_change_14": F.when(F.col("_base") != 0, F.col("momentum_14") / F.col("_base")),
        "rsi_14": oscillator(F.col("_g"), F.col("_l")),
        "bb_pct_b": F.try_divide(F.col("close") - (F.col("rolling_mean_20") - 2 * F.col("rolling_std_20")), 4 * F.col("rolling_std_20")),
        "stoch_k": F.when(span == 0, 0.0).otherwise(100 * (F.col("close") - F.col("_ll")) / span),
        "cci_20": F.when(deviation == 0, 0.0).otherwise((F.col("_tp") - F.col("_mid")) / (0.015 * deviation)),
        "mfi_14": oscillator(F.col("_pos"), F.col("_neg")),
        "vol_ratio": F.try_divide("_v10", "_v30"),
        "trend_state": sign(F.col("rolling_mean_20"), F.col("_m50")),
        "vol_regime": sign(F.col("hist_vol_20"), F.col("_hv60")),
        "momentum_regime": sign(F.col("momentum_14"), F.lit(0.0)),
    }
    return own.select("*", *[c.alias(n) for n, c in columns.items()])


def with_context(context: DataFrame, research: DataFrame, warm_up: int) -> DataFrame:
    """Features of the research bars with the context bars before them as warm-up; rows with a missing feature fall out.

    The job stops where a symbol's context has fewer than ``warm_up`` rows or does not end before its research starts.
    """
    ends = context.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    starts = research.groupBy("symbol").agg(F.min("ts").alias("start"))
    faults = starts.join(ends, "symbol", "left").where(F.coalesce(F.col("n"), F.lit(0)) < warm_up).select("symbol").unionByName(starts.join(ends, "symbol").where("end >= start").select("symbol"))
    if not faults.isEmpty():
        raise ValueError("context is too short or reaches into the research rows")
    both = context.withColumn("_own", F.lit(False)).unionByName(research.withColumn("_own", F.lit(True)))
    return feature_frame(both, True, ("_own",)).where("_own").drop("_own")


def warm_up_sensitivity(context: DataFrame, research: DataFrame) -> DataFrame:
    """Greatest relative difference of each feature between a cold start and one with context, by the age of the row."""
    long = lambda df: df.select("symbol", "ts", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])))
    both = context.withColumn("_own", F.lit(False)).unionByName(research.withColumn("_own", F.lit(True)))
    warm = long(feature_frame(both, False, ("_own",)).where("_own"))
    cold = long(feature_frame(research)).withColumnRenamed("value", "cold")
    age = row_index(research.select("symbol", "ts")).select("symbol", "ts", F.floor(F.col("idx") / 20).cast("int").alias("age"))
    joined = warm.join(cold, ["symbol", "ts", "feature"]).join(age, ["symbol", "ts"])
    gap = F.abs(F.col("value") - F.col("cold")) / F.greatest(F.abs("value"), F.lit(1e-12))
    return joined.groupBy("feature", "age").agg(F.count("*").alias("n"), F.count_if(F.col("cold").isNull() & F.col("value").isNotNull()).alias("missing"), F.max(gap).alias("most"))


def trend_strength(df: DataFrame, of: str, w: int = 20) -> DataFrame:
    """|Lag-1 autocorrelation| of the differences of a series' last ``w`` values; 0 with fewer values or no variance."""
    numbered = row_index(df.select("symbol", "ts", F.col(of).alias("v")))
    ends = numbered.groupBy("symbol").agg((F.max("idx") + 1).alias("_n"))
    own = numbered.join(ends, "symbol").where(F.col("idx") >= F.col("_n") - w)  # ``w`` rows of each series are left
    own = own.select("symbol", "ts", (F.col("v") - F.lag("v").over(W.series())).alias("d"))
    own = own.select("symbol", "d", F.lag("d").over(W.series()).alias("p"), (F.col("d") - F.avg("d").over(Window.partitionBy("symbol"))).alias("c"), F.avg("d").over(Window.partitionBy("symbol")).alias("m"))
    n = F.count("d")
    covariance = F.try_divide(F.sum(F.col("c") * (F.col("p") - F.col("m"))), n - 1)
    return own.groupBy("symbol").agg(F.when(n < w - 1, 0.0).otherwise(F.coalesce(F.abs(F.try_divide(covariance, F.var_pop("d"))), F.lit(0.0))).alias("strength"))


@reads(1)
def _turns(own: DataFrame) -> DataFrame:
    """The first row of each run of one signal."""
    before = F.lag("signal").over(W.series())
    return own.select(*base(own), "signal", "idx", "close", before.alias("_p")).where(F.col("_p").isNull() | (F.col("_p") != F.col("signal"))).drop("_p")


@reads(0, 1)
def _with_next_turn(turns: DataFrame) -> DataFrame:
    ahead = lambda c: F.lead(c).over(W.series())
    return turns.select(*base(turns), "signal", F.col("idx").alias("entry"), F.col("close").alias("entry_close"), ahead("idx").alias("exit"), ahead("close").alias("exit_close"))


def position_trades(df: DataFrame, cost: float) -> DataFrame:
    """Round trips of a signal series (symbol, ts, close, signal of 1, -1 or 0): a run of one sign is one position,
    opened at its first close and closed at the first close of the next run, or at the last close; ``cost`` is a share
    of the price on both sides. Missing signals count as 0."""
    own = row_index(df).withColumn("signal", F.coalesce("signal", F.lit(0)))
    opened = _with_next_turn(_turns(own)).where("signal <> 0")
    last = own.groupBy("symbol").agg(F.max("idx").alias("_end"), F.max_by("close", "idx").alias("_close"))
    got = opened.join(last, "symbol").withColumns({"exit": F.coalesce("exit", "_end"), "exit_close": F.coalesce("exit_close", "_close")})
    side = F.col("signal")
    entry, exit_ = F.col("entry_close") * (1 + side * cost), F.col("exit_close") * (1 - side * cost)
    return got.select("symbol", "ts", side.cast("int").alias("side"), "entry", "exit", entry.alias("entry_price"), exit_.alias("exit_price"), (side * (exit_ - entry) / entry).alias("ret"), (F.col("exit") - F.col("entry")).alias("bars_held"))


def volatility_profile(df: DataFrame, r: str, w: int = 20, periods: int = 252) -> DataFrame:
    """Per series: deviation of the last ``w`` returns (sample), the same annualised, and mean, least and greatest of
    the rolling ones."""
    own = W.rolled(df, F.stddev_samp, r, w).where("v is not null")
    return own.groupBy("symbol").agg(F.max_by("v", "ts").alias("realized"), (F.max_by("v", "ts") * periods**0.5).alias("annualized"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


@reads(lambda a: a["lookback"])
def _rolling_products(own: DataFrame, y: str, terms: list[str], pairs: list[tuple[int, int]], lookback: int) -> DataFrame:
    """Sums of products over the rows before, where there are ``lookback``, and the row's own terms."""
    frame = W.series().rowsBetween(-lookback, -1)
    sums = [F.sum(F.col(terms[i]) * F.col(terms[j])).over(frame) for i, j in pairs] + [F.sum(F.col(t) * F.col(y)).over(frame) for t in terms]
    return own.select(*base(own), F.count("*").over(frame).alias("_n"), F.array(*[s.cast("double") for s in sums]).alias("_s"), F.array(*[F.col(t).cast("double") for t in terms]).alias("_x")).where(F.col("_n") == lookback)


def factor_signal(df: DataFrame, y: str, factors: list[str], lookback: int, band: float = 0.0) -> DataFrame:
    """1, -1 or 0 by the prediction of a least-squares fit of the ``lookback`` rows before on the factors, whose current
    values are known. Rolling sums of products come from one sort; k x k systems are solved in Arrow batches."""
    terms = ["_one", *factors]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*factors, y]])
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    own = _rolling_products(df.where(complete).withColumn("_one", F.lit(1.0)), y, terms, pairs, lookback)
    k = len(terms)

    def solve(batches):
        for batch in batches:
            s, x = np.array(batch["_s"].tolist()).reshape(-1, len(pairs) + k), np.array(batch["_x"].tolist()).reshape(-1, k)
            gram = np.empty((len(s), k, k))
            for at, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = s[:, at]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), s[:, len(pairs) :])
            yield pd.DataFrame({"symbol": batch["symbol"], "ts": batch["ts"], "prediction": np.einsum("ni,ni->n", beta, x)})

    found = own.mapInPandas(solve, "symbol string, ts timestamp, prediction double")
    return found.withColumn("signal", F.when(F.col("prediction") > band, 1).when(F.col("prediction") < -band, -1).otherwise(0))


def return_statistics(df: DataFrame, r: str) -> DataFrame:
    """Ordered return statistics per series: mean, sample deviation, skew, excess kurtosis of the population, and the
    deviation of the later half of the rows over that of the earlier less 1."""
    numbered = row_index(df.where(F.col(r).isNotNull()).select("symbol", "ts", F.col(r).alias("r")))
    halves = numbered.groupBy("symbol").agg(F.floor(F.count("*") / 2).alias("_half"))
    own = numbered.join(halves, "symbol").select("symbol", "r", (F.col("idx") >= F.col("_half")).alias("_late"))
    early, late = F.stddev_samp(F.when(~F.col("_late"), F.col("r"))), F.stddev_samp(F.when(F.col("_late"), F.col("r")))
    return own.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("volatility"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"), (F.try_divide(late, early) - 1).alias("volatility_change"))


def confident_trades(df: DataFrame, by: str, least: float = 0.6, periods: int = 252) -> DataFrame:
    """Trades (uncertainty, ret) with a confidence of 1 / (1 + uncertainty) of at least ``least``: how many, their sum,
    annualised Sharpe ratio (0 for one trade or no deviation) and mean confidence."""
    c = 1 / (1 + F.col("uncertainty"))
    kept = df.where(c >= least)
    sd = F.stddev_pop("ret")
    sharpe = F.when((F.count("*") > 1) & (sd > 1e-9), periods**0.5 * F.try_divide(F.avg("ret"), sd)).otherwise(0.0)
    return kept.groupBy(by).agg(F.count("*").alias("trades"), F.sum("ret").alias("total"), sharpe.alias("sharpe"), F.avg(c).alias("mean_confidence"), F.avg("uncertainty").alias("mean_uncertainty"))


def fitted_intervals(df: DataFrame, y: str, x: str, level: float = 0.95, by: str | list[str] = "symbol") -> DataFrame:
    """Intervals of a fitted line per group: the slope +- t standard errors, and the prediction at the mean of x
    +- t s sqrt(1 + 1/n), s being the residual deviation (n - 2) and t the critical value for n - 2 degrees of freedom."""
    by = [by] if isinstance(by, str) else by
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"), F.regr_syy(y, x).alias("_yy"), F.avg(F.col(y)).alias("_y"))
    s = F.sqrt(F.try_divide(F.greatest(F.col("_yy") - F.try_divide(F.col("_xy") ** 2, F.col("_xx")), F.lit(0.0)), F.col("n") - 2))
    own = fit.withColumn("s", s).withColumn("_se", F.try_divide(F.col("s"), F.sqrt("_xx"))).withColumn("t", critical(level, F.col("n") - 2))
    t, wide = F.col("t"), F.col("t") * F.col("s") * F.sqrt(1 + 1 / F.col("n"))
    return own.select(*by, "n", "slope", (F.col("slope") - t * F.col("_se")).alias("slope_lo"), (F.col("slope") + t * F.col("_se")).alias("slope_hi"), (F.col("_y") - wide).alias("next_lo"), (F.col("_y") + wide).alias("next_hi"))
