"""Bootstrap intervals and sign-flip tests by replicate accumulators.

Rows are not multiplied by the replicates. A task keeps, for each group, one vector per moment with an entry for each
replicate; a row adds its weight in every replicate, a number that its key, the seed and the replicate fix. Only the
vectors are shuffled: their size does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities.
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.00306566200976202, 0.000510943668293670])
#: Rows weighed at once, and groups that a task keeps before it hands their vectors on.
ROWS, GROUPS = 2048, 512


def uniforms(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key (64 bits) and replicate."""
    with np.errstate(over="ignore"):
        salt = (np.arange(replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = keys.astype(np.uint64)[:, None] ^ salt
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2**53


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    return np.searchsorted(_POISSON, uniforms(keys, replicates, seed), "right").astype(float)


def signs(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    return np.where(uniforms(keys, replicates, seed) < 0.5, -1.0, 1.0)


def _accumulated(df: DataFrame, x: str, row_key: str | Column, by: str, replicates: int, seed: int, weigh) -> DataFrame:
    """by, replicate, w, wx, wxx: sums of the weights, and of values and squares under them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            rows = [(g, *(m.tolist() for m in moments)) for g, moments in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["g", "w", "wx", "wxx"])

        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.iloc[lo : lo + ROWS]
                weights, values = weigh(part["h"].to_numpy(np.int64).view(np.uint64), replicates, seed), part["v"].to_numpy(float)
                for g, at in part.groupby("g", dropna=False).indices.items():
                    w, v = weights[at], values[at]
                    add = np.array([w.sum(0), v @ w, (v * v) @ w])
                    held[g] = held[g] + add if g in held else add
            if len(held) > GROUPS:
                yield out()
        if held:
            yield out()

    kind = dict(df.dtypes)[by]
    key = F.xxhash64(row_key)
    own = df.where(F.col(x).isNotNull()).select(F.col(by).alias("g"), F.col(x).cast("double").alias("v"), key.alias("h"))
    vectors = own.mapInPandas(run, f"g {kind}, w array<double>, wx array<double>, wxx array<double>")
    long = vectors.select(F.col("g").alias(by), F.posexplode(F.arrays_zip("w", "wx", "wxx")).alias("replicate", "m"))
    return long.groupBy(by, "replicate").agg(*[F.sum(F.col("m")[c]).alias(c) for c in ("w", "wx", "wxx")])


def bootstrap(df: DataFrame, x: str, row_key: str | Column, by: str, replicates: int = 200, seed: int = 7, level: float = 0.95, statistic: str = "mean", periods: int = 252) -> DataFrame:
    """Percentile interval of a statistic by Poisson replicate weights: ``mean`` (of a 0/1 column, a rate), or ``sharpe``,
    the annualised ratio of the mean to the population deviation (0 where nothing varies). Per group: lo, hi, mean of
    the replicates and their number; replicates in which no row has weight are left out."""
    m = F.try_divide("wx", "w")
    variance = F.greatest(F.try_divide("wxx", "w") - m * m, F.lit(0.0))
    value = m if statistic == "mean" else F.when(variance > 1e-18 * m * m, periods**0.5 * m / F.sqrt(variance)).otherwise(0.0)
    found = _accumulated(df, x, row_key, by, replicates, seed, poisson_weights).where("w > 0").withColumn("s", value)
    a = (1 - level) / 2
    return found.groupBy(by).agg(F.percentile("s", F.lit(a)).alias("lo"), F.percentile("s", F.lit(1 - a)).alias("hi"), F.avg("s").alias("mean"), F.count("s").alias("replicates"))


def sign_flip_p(df: DataFrame, x: str, row_key: str | Column, by: str, permutations: int = 200, seed: int = 7) -> DataFrame:
    """Two-sided p-value of a zero mean by random signs: (1 + as extreme) / (1 + permutations)."""
    flipped = _accumulated(df, x, row_key, by, permutations, seed, signs)
    seen = df.where(F.col(x).isNotNull()).groupBy(by).agg(F.sum(F.col(x).cast("double")).alias("_sum"))
    extreme = F.count_if(F.abs("wx") >= F.abs("_sum") * (1 - 1e-12))
    return flipped.join(seen, by).groupBy(by).agg(((extreme + 1) / (F.count("*") + 1)).alias("p"))
