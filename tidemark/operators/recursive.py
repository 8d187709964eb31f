"""Recursive smoothing and path-dependent indicators as folds over blocks of a series.

What is linear in its own past (exponential and Wilder means, Kalman, GARCH) goes through :func:`linear_fold`; state
machines (Supertrend, parabolic stop) go through :func:`coalescing_fold`. No task holds a whole series.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, as_blocks, base, coalescing_fold, linear_fold
from tidemark.operators.windows import previous, rows as last_rows, true_range, typical


def decayed(x: np.ndarray, keep: float, y: float | None, weight: float | None = None) -> np.ndarray:
    """y = keep y + weight x along ``x`` (weight 1 - keep unless given); from the first value on where y is None."""
    weight = 1 - keep if weight is None else weight
    if y is None:
        rest = accumulate((weight * x[1:]).tolist(), lambda a, v: keep * a + v, initial=float(x[0]))
        return np.fromiter(rest, float, len(x))
    return np.fromiter(accumulate((weight * x).tolist(), lambda a, v: keep * a + v, initial=y), float, len(x) + 1)[1:]


def seeded(x: np.ndarray, k: np.ndarray, period: int, y: float, keep: float | None = None, skip: int = 0) -> tuple[np.ndarray, float]:
    """Smoothing that starts from the mean of the ``period`` values from place ``skip`` on: null before, then y = keep y +
    (1 - keep) x; Wilder's keep is 1 - 1 / period. ``k``: place of each value in the series, -1 where it is missing;
    ``y``: the sum so far, or the mean once it is full. Returned with the last ``y``."""
    keep = 1 - 1 / period if keep is None else keep
    full, out = skip + period - 1, np.full(len(x), np.nan)
    for i, (v, at) in enumerate(zip(x.tolist(), k.tolist())):
        if at < skip:
            continue
        if at < full:
            y += v
        else:
            y = (y + v) / period if at == full else keep * y + (1 - keep) * v
            out[i] = y
    return out, y


def _narrow(bars: DataFrame | Blocks, columns: dict[str, Column], back: int = 0) -> Blocks:
    return as_blocks(bars, back).extend(lambda d: d.select(*base(d), *[c.cast("double").alias(n) for n, c in columns.items()]), back)


def _finished(blocks: Blocks, **columns: Column) -> DataFrame:
    return blocks.own(blocks.frame.select(*base(blocks.frame), *[c.alias(n) for n, c in columns.items()]))


def ema(df: DataFrame | Blocks, of: str, span: int, out: str, seed: str = "first") -> DataFrame:
    """Exponential mean with weight 2 / (span + 1): from the first value on, or from the mean of the first ``span``."""
    keep = 1 - 2.0 / (span + 1)

    def fold(rows: pd.DataFrame, state):
        x = rows["x"].to_numpy()
        if seed == "mean":
            y, last = seeded(x, rows["__idx"].to_numpy(), span, 0.0 if state is None else state[0], keep)
            return {out: y}, np.array([last])
        y = decayed(x, keep, None if state is None else state[0])
        return {out: y}, y[-1:]

    return _finished(linear_fold(_narrow(df, {"x": F.col(of)}), fold, 1, [out]), **{out: F.col(out)})


def macd_lines(blocks: Blocks, fast: int = 12, slow: int = 26, signal: int = 9) -> Blocks:
    """Blocks with the columns fast, slow and signal: three recurrences in one pass."""
    keeps = [1 - 2.0 / (n + 1) for n in (fast, slow, signal)]

    def fold(rows: pd.DataFrame, state):
        x = rows["close"].to_numpy()
        starts = [None] * 3 if state is None else state
        f, s = (decayed(x, k, y) for k, y in zip(keeps[:2], starts))
        g = decayed(f - s, keeps[2], starts[2])
        return {"fast": f, "slow": s, "signal": g}, np.array([f[-1], s[-1], g[-1]])

    return linear_fold(blocks, fold, 3, ["fast", "slow", "signal"])


def macd(bars: DataFrame | Blocks, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    own = macd_lines(_narrow(bars, {"close": F.col("close")}), fast, slow, signal)
    return _finished(own, fast=F.col("fast"), slow=F.col("slow"), macd=F.col("fast") - F.col("slow"), signal=F.col("signal"))


def keltner(bars: DataFrame | Blocks, period: int = 20, atr_period: int = 10, width: float = 2.0) -> DataFrame:
    """Exponential mean of the close (first-value seed) and a band of ``width`` Wilder ranges; the band is null until the
    range is full."""

    def fold(rows: pd.DataFrame, state):
        mid = decayed(rows["close"].to_numpy(), 1 - 2.0 / (period + 1), None if state is None else state[0])
        atr, last = seeded(rows["tr"].to_numpy(), rows["__idx"].to_numpy(), atr_period, 0.0 if state is None else state[1])
        return {"mid": mid, "atr": atr}, np.array([mid[-1], last])

    own = linear_fold(_narrow(bars, {"close": F.col("close"), "tr": true_range()}, 1), fold, 2, ["mid", "atr"])
    return _finished(own, upper=F.col("mid") + width * F.col("atr"), middle=F.col("mid"), lower=F.col("mid") - width * F.col("atr"))


def _wilder_fold(columns: dict[str, int], period: int):
    """Wilder means of columns, each from a place on."""

    def fold(rows: pd.DataFrame, state):
        k, out, last = rows["__idx"].to_numpy(), {}, []
        for i, (c, skip) in enumerate(columns.items()):
            out[f"s_{c}"], y = seeded(rows[c].to_numpy(), k, period, 0.0 if state is None else state[i], skip=skip)
            last.append(y)
        return out, np.array(last)

    return fold


def _share(top: str, bottom: str) -> Column:
    """100 - 100 / (1 + top / bottom), and 100 where the bottom is 0."""
    return F.when(F.col(bottom) == 0, 100.0).otherwise(100 - 100 / (1 + F.col(top) / F.col(bottom)))


def wilder(bars: DataFrame | Blocks, period: int = 14) -> DataFrame:
    """RSI, ATR and money flow index with Wilder smoothing."""
    step, before = F.col("close") - previous("close"), previous(typical())
    flow = typical() * F.col("volume")
    columns = {"g": F.greatest(step, F.lit(0.0)), "l": F.greatest(-step, F.lit(0.0)), "tr": true_range(), "up": F.when(typical() > before, flow).otherwise(0.0), "down": F.when(typical() < before, flow).otherwise(0.0)}
    skips = {"g": 1, "l": 1, "tr": 0, "up": 1, "down": 1}
    own = linear_fold(_narrow(bars, columns, 1), _wilder_fold(skips, period), len(skips), [f"s_{c}" for c in skips])
    return _finished(own, rsi=_share("s_g", "s_l"), atr=F.col("s_tr"), mfi=_share("s_up", "s_down"))


def directional(bars: DataFrame | Blocks, period: int = 14) -> DataFrame:
    """Directional movement with Wilder smoothing: +DI, -DI, ADX and ADXR.

    Where the smoothed range is 0 both lines are 0 and there is no DX, so the row adds nothing to ADX. ADX starts from
    the mean of the first ``period`` values of DX; ADXR is its mean with the ADX ``period`` rows before.
    """
    up, down = F.col("high") - previous("high"), previous("low") - F.col("low")
    columns = {"tr": true_range(), "plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    own = linear_fold(_narrow(bars, columns, 1), _wilder_fold(dict.fromkeys(columns, 0), period), 3, [f"s_{c}" for c in columns])
    line = lambda c: F.when(F.col("s_tr") == 0, 0.0).otherwise(100 * F.col(f"s_{c}") / F.col("s_tr"))
    own = own.extend(lambda d: d.select(*base(d), "s_tr", line("plus").alias("plus_di"), line("minus").alias("minus_di")))
    both = F.col("plus_di") + F.col("minus_di")
    dx = F.when(F.col("s_tr") == 0, None).when(both == 0, 0.0).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both)
    own = own.extend(lambda d: d.select(*base(d), "plus_di", "minus_di", dx.alias("dx"))).running({"seen": F.when(F.col("dx").isNotNull(), 1).otherwise(0)})
    own = own.extend(lambda d: d.withColumn("k", F.when(F.col("dx").isNotNull(), F.col("seen") - 1).otherwise(-1).cast("long")).drop("seen"))

    def fold(rows: pd.DataFrame, state):
        y, last = seeded(rows["dx"].to_numpy(float), rows["k"].to_numpy(), period, 0.0 if state is None else state[0])
        return {"adx": y}, np.array([last])

    own = linear_fold(own, fold, 1, ["adx"])
    got = own.named(own.frame.where(own.inside())).select("symbol", "ts", "__idx", "plus_di", "minus_di", "adx")
    earlier = got.select("symbol", (F.col("__idx") + period).alias("__idx"), F.col("adx").alias("_before"))
    return got.join(earlier, ["symbol", "__idx"], "left").select("symbol", "ts", "plus_di", "minus_di", "adx", ((F.col("adx") + F.col("_before")) / 2).alias("adxr"))


def gains(n: int, q: float, r: float) -> list[float]:
    """Kalman gains of the first ``n`` steps; they depend on the row number alone and settle quickly."""
    out, p = [], 1.0
    for _ in range(n):
        p += q
        k = p / (p + r)
        out.append(k)
        p *= 1 - k
    return out


def kalman(bars: DataFrame | Blocks, q: float = 0.01, r: float = 1.0, settled: int = 400) -> DataFrame:
    """Scalar Kalman trend from the first close on; after ``settled`` steps the gain is the limit to machine precision."""
    table = np.array([1.0, *gains(settled, q, r)])

    def fold(rows: pd.DataFrame, state):
        x, k = rows["close"].to_numpy(), table[np.minimum(rows["__idx"].to_numpy(), settled)]
        y, out = 0.0 if state is None else state[0], np.empty(len(x))
        # the gain of row i follows i - 1 steps: the first row takes the close as it is
        for i, (v, g) in enumerate(zip(x.tolist(), k.tolist())):
            y = out[i] = y + g * (v - y)
        return {"trend": out}, out[-1:]

    return _finished(linear_fold(_narrow(bars, {"close": F.col("close")}), fold, 1, ["trend"]), trend=F.col("trend"))


def garch(df: DataFrame | Blocks, r: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """Variance path s_t = omega + alpha r_(t-1)^2 + beta s_(t-1) from the long-run variance on."""

    def fold(rows: pd.DataFrame, state):
        step = omega + alpha * rows["before"].to_numpy(float) ** 2
        if state is None:
            step[0] = omega / (1 - alpha - beta)
        y = decayed(step, beta, 0.0 if state is None else state[0], 1.0)
        return {"variance": y}, y[-1:]

    return _finished(linear_fold(_narrow(df, {"before": previous(r)}, 1), fold, 1, ["variance"]), variance=F.col("variance"))


def _supertrend(rows: pd.DataFrame, state: np.ndarray, width: float) -> tuple[np.ndarray, list[float]]:
    """Trend line of rows that hold their range and the close before; ``state``: direction, upper and lower band."""
    up, top, bottom = bool(state[0]), float(state[1]), float(state[2])
    out = np.full(len(rows), np.nan)
    for i, (h, low, c, atr, before) in enumerate(zip(*(rows[n].to_numpy(float).tolist() for n in ("high", "low", "close", "atr", "close_1")))):
        if atr != atr:
            continue
        mid = (h + low) / 2
        above, below = mid + width * atr, mid - width * atr
        top = above if above < top or before > top else top
        bottom = below if below > bottom or before < bottom else bottom
        up = c >= bottom if up else c > top
        out[i] = bottom if up else top
    return out, [float(up), top, bottom]


def _parabolic(rows: pd.DataFrame, state: np.ndarray, first: bool, step: float, most: float) -> tuple[np.ndarray, list[float]]:
    """Stop and reverse; ``state``: stop, direction, extreme of the move and its speed."""
    stop, rising, best, speed = float(state[0]), bool(state[1]), float(state[2]), float(state[3])
    out = np.full(len(rows), np.nan)
    columns = (rows[n].to_numpy(float).tolist() for n in ("high", "low", "high_1", "low_1", "high_2", "low_2"))
    for i, (h, low, h1, l1, h2, l2) in enumerate(zip(*columns)):
        if first and i == 0:
            out[0] = stop
            continue
        now = stop + speed * (best - stop)
        if rising:
            now = min(now, l1, l2)
            if low < now:
                now, rising, best, speed = best, False, low, step
            elif h > best:
                best, speed = h, min(speed + step, most)
        else:
            now = max(now, h1, h2)
            if h > now:
                now, rising, best, speed = best, True, h, step
            elif low < best:
                best, speed = low, min(speed + step, most)
        stop = out[i] = now
    return out, [stop, float(rising), best, speed]


def path_dependent(bars: DataFrame | Blocks, period: int = 10, width: float = 3.0, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """Supertrend and parabolic SAR. Blocks start from a guessed state, a rising trend; bands that are set anew and
    stops that turn at the same extreme bring the paths together."""
    mean_range = F.when(F.count("tr").over(last_rows(period)) == period, F.avg("tr").over(last_rows(period)))

    def columns(d: DataFrame) -> DataFrame:
        own = d.select(*base(d), "high", "low", "close", true_range().alias("tr"))
        second = {f"{c}_2": F.coalesce(previous(c, 2), previous(c)) for c in ("high", "low")}
        return own.select(*base(own), "high", "low", "close", mean_range.alias("atr"), *[previous(c).alias(f"{c}_1") for c in ("high", "low", "close")], *[c.alias(n) for n, c in second.items()]).withColumn("close_1", F.coalesce("close_1", "close"))

    def guess(rows: pd.DataFrame) -> np.ndarray:
        first = rows.iloc[0]
        return np.array([1.0, np.inf, -np.inf, first["low_1"], 1.0, first["high_1"], step])

    def fold(rows: pd.DataFrame, state):
        start = state
        if state is None:
            first = rows.iloc[0]
            start = np.array([1.0, np.inf, -np.inf, first["low"], 1.0, first["high"], step])
        trend, a = _supertrend(rows, start[:3], width)
        stop, b = _parabolic(rows, start[3:], state is None, step, most)
        return {"supertrend": trend, "sar": stop}, np.array(a + b)

    own = coalescing_fold(as_blocks(bars, period + 2).extend(columns, period + 2), fold, guess, ["supertrend", "sar"])
    return _finished(own, supertrend=F.col("supertrend"), sar=F.col("sar"))


def change_points(df: DataFrame | Blocks, x: str, threshold: float | None = None) -> DataFrame:
    """Change points: sums of deviations from the series mean less half a threshold, up and down, each set back to 0
    where it passes the threshold; by default four population deviations of the series, or 1 for a constant one. Sums
    that are held at 0 or set back bring paths from different starts together."""
    rows = df.rows() if isinstance(df, Blocks) else df
    rows = rows.select("symbol", "ts", F.col(x).cast("double").alias("v")).where("v is not null")
    level = F.when(F.stddev_pop("v") > 0, 4 * F.stddev_pop("v")).otherwise(1.0) if threshold is None else F.lit(float(threshold))
    known = rows.groupBy("symbol").agg(F.avg("v").alias("mean"), level.alias("limit"))
    blocks = as_blocks(rows.join(known, "symbol"), 0)

    def fold(rows: pd.DataFrame, state):
        up, down = (0.0, 0.0) if state is None else state.tolist()
        out = np.full(len(rows), np.nan)
        for i, (v, mean, limit) in enumerate(zip(rows["v"].tolist(), rows["mean"].tolist(), rows["limit"].tolist())):
            up, down = max(0.0, up + v - mean - limit / 2), max(0.0, down - v + mean - limit / 2)
            if up > limit:
                out[i], up = up, 0.0
            elif down > limit:
                out[i], down = -down, 0.0
        return {"level": out}, np.array([up, down])

    own = coalescing_fold(blocks, fold, lambda rows: np.zeros(2), ["level"])
    return _finished(own, level=F.col("level")).where("level is not null")
