"""What users add: indicators by name, predicates, strategies, labels and statistics of their own.

Column functions stay inside Spark's plan and come first; functions over pandas frames run one series (or replicate) at a
time in Arrow batches, so one series must fit a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as W

#: name -> (category, parameters with their defaults, function of a frame and the parameters)
INDICATORS: dict[str, tuple[str, dict[str, float], Callable[..., DataFrame]]] = {}


def indicator(name: str, category: str, **defaults: float):
    """Registers ``f(bars, **parameters) -> DataFrame`` (symbol, ts, values) under a name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        INDICATORS[name] = (category, defaults, f)
        return f

    return register


def compute(bars: DataFrame, name: str, **parameters: float) -> DataFrame:
    """One registered indicator. Unknown names or parameters, and periods or widths that are not positive, are errors;
    whole-numbered parameters are taken as such."""
    if name not in INDICATORS:
        raise KeyError(f"unknown indicator {name!r}; there are {sorted(INDICATORS)}")
    _, defaults, f = INDICATORS[name]
    if unknown := set(parameters) - set(defaults):
        raise ValueError(f"{name} has no {sorted(unknown)}")
    chosen = {k: int(parameters.get(k, v)) if isinstance(v, int) else float(parameters.get(k, v)) for k, v in defaults.items()}
    if bad := [k for k, v in chosen.items() if v <= 0]:
        raise ValueError(f"{bad} of {name} must be positive")
    return f(bars, **chosen)


def compute_batch(bars: DataFrame, specs: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """Several indicators in long form: symbol, ts, indicator, field, value."""
    parts = []
    for name, parameters in specs:
        got = compute(bars, name, **parameters)
        fields = [c for c in got.columns if c not in ("symbol", "ts")]
        parts.append(got.select("symbol", "ts", F.lit(name).alias("indicator"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields]))))
    return reduce(DataFrame.unionByName, parts)


@indicator("sma", "trend", period=20)
def _sma(bars: DataFrame, period: int) -> DataFrame:
    return bars.select("symbol", "ts", W.sma("close", period).alias("sma"))


@indicator("bollinger", "volatility", period=20, std_dev=2.0)
def _bollinger(bars: DataFrame, period: int, std_dev: float) -> DataFrame:
    return W.bands(bars, period, std_dev).select("symbol", "ts", "mid", "upper", "lower")


@indicator("stochastic", "momentum", period=14, smooth=3, signal=3)
def _stochastic(bars: DataFrame, period: int, smooth: int, signal: int) -> DataFrame:
    return W.stochastic(bars, period, smooth, signal)


@indicator("cci", "momentum", period=20)
def _cci(bars: DataFrame, period: int) -> DataFrame:
    return W.cci(bars, period)


def mapped(rows: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Records changed and filtered by column expressions."""
    own = rows.where(keep) if keep is not None else rows
    return own.withColumns(columns)


def mapped_frames(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Records changed by a function over pandas batches, where no expression says it."""

    def run(batches):
        for batch in batches:
            yield f(batch)

    return rows.mapInPandas(run, schema)


def strategy(bars: DataFrame, f: Callable[[pd.DataFrame], pd.Series], by: str = "symbol") -> DataFrame:
    """Signals of a user's rule over one series in time order: by, ts, close, signal (1, -1 or 0; missing is 0)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts").reset_index(drop=True)
        signal = np.sign(pd.Series(np.asarray(f(rows), float)).fillna(0)).astype("int32")
        return pd.DataFrame({by: rows[by], "ts": rows["ts"], "close": rows["close"], "signal": signal})

    types = dict(bars.dtypes)
    return bars.groupBy(by).applyInPandas(run, f"{by} {types[by]}, ts {types['ts']}, close double, signal int")


def with_labels(features: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """Features with a user's label of the same symbol and time; rows without one fall out, a repeated one is an error."""
    own = labels.select("symbol", "ts", F.col(name).alias("label"))
    if not own.groupBy("symbol", "ts").count().where("count > 1").isEmpty():
        raise ValueError("a label is given twice")
    return features.join(own, ["symbol", "ts"]).where(F.col("label").isNotNull())


#: Cumulative Poisson(1) probabilities, rows weighed at once, and distinct values that a task keeps before it hands them on.
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.00306566200976202, 0.000510943668293670])
ROWS, PAGE = 2048, 1024


def _weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson weight of each key (64 bits) in each replicate."""
    salt = np.array([seed * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF for r in range(replicates)], np.uint64)
    mixed = (keys[:, None] ^ salt) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    u = (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, u)


def bootstrap_statistic(df: DataFrame, x: str, row_key: str, by: str, f: Callable[[np.ndarray, np.ndarray], float], replicates: int = 200, seed: int = 7, level: float = 0.95, parts: int = 32) -> DataFrame:
    """Percentile interval of a statistic that is no weighted mean: ``f(values, weights)`` for each replicate of Poisson
    weights. ``f`` takes a group's distinct values in order, so a task holds these with the weights of one of ``parts``
    blocks of replicates, never its rows: rows of one value meet in order, and only the sums of their weights go on, a
    page of values at a time."""
    a = (1 - level) / 2

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, values, sums = None, [], []  # the last value of a page may go on in the next rows

        def page(k: int) -> pd.DataFrame:
            own = np.array(sums[:k])
            rows = [(group, b, values[:k], own[:, b::parts].ravel()) for b in range(min(parts, replicates))]
            del values[:k], sums[:k]
            return pd.DataFrame(rows, columns=[by, "_b", "_values", "_weights"])

        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                rows = batch.iloc[lo : lo + ROWS]
                v, code = rows["_x"].to_numpy(float), pd.factorize(rows[by], use_na_sentinel=False)[0]
                same = (code[1:] == code[:-1]) & ((v[1:] == v[:-1]) | np.isnan(v[1:]) & np.isnan(v[:-1]))
                first = np.r_[0, np.flatnonzero(~same) + 1]
                added = np.add.reduceat(_weights(rows["_h"].to_numpy(np.int64).view(np.uint64), replicates, seed), first, axis=0)
                for at, w in zip(first, added):
                    g, value = rows[by].iat[at], v[at]
                    if values and not (g == group or pd.isna(g) and pd.isna(group)):
                        yield page(len(values))
                    if values and (values[-1] == value or np.isnan(values[-1]) and np.isnan(value)):
                        sums[-1] = sums[-1] + w
                        continue
                    group = g
                    values.append(value)
                    sums.append(w)
                    if len(values) > PAGE:
                        yield page(PAGE)
        if values:
            yield page(len(values))

    def apply(pages: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate(pages["_values"].to_numpy())
        block = int(pages["_b"].iloc[0])
        weights = np.concatenate(pages["_weights"].to_numpy()).reshape(len(values), -1)
        order = np.argsort(values)
        values = values[order]
        return pd.DataFrame([(pages[by].iloc[0], float(f(values, weights[order, k].astype(float)))) for k in range(len(range(block, replicates, parts)))], columns=[by, "statistic"])

    kind = dict(df.dtypes)[by]
    own = df.where(F.col(x).isNotNull()).select(by, (F.col(x).cast("double") + F.lit(0.0)).alias("_x"), F.xxhash64(row_key).alias("_h"))
    pages = own.repartition(by, "_x").sortWithinPartitions(by, "_x").mapInPandas(weigh, f"{by} {kind}, _b int, _values array<double>, _weights array<int>")
    found = pages.groupBy(by, "_b").applyInPandas(apply, f"{by} {kind}, statistic double")
    return found.groupBy(by).agg(F.percentile("statistic", F.lit(a)).alias("lo"), F.percentile("statistic", F.lit(1 - a)).alias("hi"), F.avg("statistic").alias("mean"), F.count("*").alias("replicates"))
