"""Signals of indicators: each by itself, two of three together, and trend with momentum and volatility."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, as_blocks, base, linear_fold
from tidemark.operators.recursive import decayed, seeded
from tidemark.operators.windows import previous, rolling, rows, sma, true_range

#: Rows that the windows below read back: the mean of 50 closes, and 20 means of 14 ranges with the close before.
REACH = 50


def _features(d: DataFrame) -> DataFrame:
    mid, sd = sma("close", 20), rolling(F.stddev_pop, "close", 20)
    own = d.select(*base(d), "close", (F.col("close") - previous("close")).alias("step"), true_range().alias("_tr"))
    own = own.select(*base(own), "close", F.greatest("step", F.when(F.col("step").isNotNull(), 0.0)).alias("gain"), F.greatest(-F.col("step"), F.when(F.col("step").isNotNull(), F.lit(0.0))).alias("loss"), "_tr")
    own = own.select("*", sma("_tr", 14).alias("atr"), sma("close", 20).alias("m20"), sma("close", 50).alias("m50"), mid.alias("mid"), sd.alias("sd"))
    return own.select(*base(own), "close", "gain", "loss", "m20", "m50", "mid", "sd", "atr", F.when(F.count("atr").over(rows(20)) == 20, F.avg("atr").over(rows(20))).alias("atr20"))


def _fold(part: pd.DataFrame, state):
    """MACD histogram and the one before, Wilder means of gains and losses from a mean of 14 (a, b), and exponential ones
    from the first value (g, l); the state is linear."""
    x, gain, loss, k = (part[c].to_numpy(float) for c in ("close", "gain", "loss", "__idx"))
    fresh = state is None
    s = np.zeros(7) if fresh else state
    keeps = [1 - 2.0 / (n + 1) for n in (12, 26, 9)]
    f, w = (decayed(x, keeps[i], None if fresh else s[i]) for i in (0, 1))
    signal = decayed(f - w, keeps[2], None if fresh else s[2])
    hist = f - w - signal
    up, a = seeded(np.nan_to_num(gain), k, 14, s[3], skip=1)
    down, b = seeded(np.nan_to_num(loss), k, 14, s[4], skip=1)
    if fresh:
        g, l = (np.r_[np.nan, decayed(v[1:], 13 / 14, None)] if len(v) > 1 else np.full(1, np.nan) for v in (gain, loss))
    else:
        g, l = decayed(gain, 13 / 14, s[5]), decayed(loss, 13 / 14, s[6])
    out = {"hist": hist, "before": np.r_[np.nan if fresh else s[0] - s[1] - s[2], hist[:-1]], "up": up, "down": down, "g": g, "l": l}
    return out, np.array([f[-1], w[-1], signal[-1], a, b, *np.nan_to_num([g[-1], l[-1]])])


def _vote(buy: Column, sell: Column) -> Column:
    return F.when(buy, 1).when(sell, -1).otherwise(0)


def indicator_signals(bars: DataFrame | Blocks) -> DataFrame:
    """Per bar, 1 to buy, -1 to sell, else 0: RSI below 30 or above 70; the MACD histogram turning positive or negative;
    a close outside the Bollinger bands; two of these three together (from the 36th bar on) with the share of votes as
    confidence; and the trend of the averages of 20 and 50 where RSI agrees and the range is above its average."""
    blocks = as_blocks(bars, REACH).extend(_features, REACH)
    own = linear_fold(blocks, _fold, 7, ["hist", "before", "up", "down", "g", "l"])
    df = own.frame
    rsi = F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up", "down")))
    late = F.col("__idx") >= 34  # the first histogram is that of 26 and 9 values
    votes = {
        "rsi_signal": _vote(rsi < 30, rsi > 70),
        "macd_signal": F.when(late, _vote((F.col("hist") > 0) & (F.col("before") <= 0), (F.col("hist") < 0) & (F.col("before") >= 0))).otherwise(0),
        "band_signal": _vote(F.col("close") < F.col("mid") - 2 * F.col("sd"), F.col("close") > F.col("mid") + 2 * F.col("sd")),
    }
    df = df.withColumns(votes)
    buys, sells = (sum(((F.col(v) == side).cast("int") for v in votes), F.lit(0)) for side in (1, -1))
    df = df.withColumns({"_buys": F.when(F.col("__idx") >= 35, buys).otherwise(0), "_sells": F.when(F.col("__idx") >= 35, sells).otherwise(0)})
    ensemble = _vote(F.col("_buys") >= 2, F.col("_sells") >= 2)
    confidence = F.when(F.col("_buys") >= 2, F.col("_buys") / 3.0).when(F.col("_sells") >= 2, F.col("_sells") / 3.0)
    known = F.col("__idx") >= 14
    smooth = F.when(F.col("l") == 0, F.when(F.col("g") > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide("g", "l")))
    volatile = known & (F.col("atr") > F.col("atr20"))
    both = _vote(volatile & (F.col("m20") > F.col("m50")) & (smooth > 50), volatile & (F.col("m20") < F.col("m50")) & (smooth < 50))
    return own.own(df.select(*base(df), *votes, ensemble.alias("ensemble"), confidence.alias("confidence"), both.alias("multi_signal")))
