"""Regressions and time-series tests from sums of products: Spark sums rows, small solves see k x k numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _solve(k: int, by: str, by_type: str):
    """Solve the centred normal equations of each group from its moments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, mean, moments in zip(batch["_key"], batch["n"], batch["_mean"], batch["_moments"]):
                mean = np.asarray(mean, float)
                c = np.zeros((k + 1, k + 1))
                c[np.triu_indices(k + 1)] = moments
                c = c + np.triu(c, 1).T
                sxx, sxy, syy = c[1:, 1:], c[1:, 0], c[0, 0]
                scale = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
                slope = np.linalg.lstsq(sxx / np.outer(scale, scale), sxy / scale, rcond=1e-12)[0] / scale
                rss = max(syy - slope @ sxy, 0.0)
                free = n - k - 1
                inverse = np.linalg.pinv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
                error = np.sqrt(np.maximum(np.diag(inverse) * rss / free, 0)) if free > 0 else np.full(k, np.nan)
                rows.append((key, int(n), [float(mean[0] - slope @ mean[1:]), *map(float, slope)], [float(e) for e in error], float(1 - rss / syy) if syy > 0 else 0.0, float(rss), float(free)))
            yield pd.DataFrame(rows, columns=[by, "n", "beta", "error", "r2", "rss", "free"])

    return run, f"{by} {by_type}, n long, beta array<double>, error array<double>, r2 double, rss double, free double"


def least_squares(df: DataFrame, y: str, xs: list[str], by: str = "symbol") -> DataFrame:
    """Least squares of y on several x per group: beta (intercept first), error of the slopes, r2, rss.

    Columns are centred on their group means first, then one aggregate takes all sums of products.
    """
    columns = [y, *xs]
    own = df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(by, *columns)
    means = own.groupBy(by).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    centred = own.join(means, by).select(by, *[(F.col(c) - F.col(f"_m{i}")).alias(f"_c{i}") for i, c in enumerate(columns)], *[f"_m{i}" for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = centred.groupBy(F.col(by).alias("_key")).agg(F.count("*").alias("n"), F.array(*[F.first(f"_m{i}") for i in range(len(columns))]).alias("_mean"), F.array(*[F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i, j in pairs]).alias("_moments"))
    run, schema = _solve(len(xs), by, dict(df.dtypes)[by])
    return sums.mapInPandas(run, schema)


def polynomial(df: DataFrame, y: str, x: str, degree: int, by: str = "symbol") -> DataFrame:
    powers = [f"_p{k}" for k in range(1, degree + 1)]
    return least_squares(df.withColumns({p: F.col(x) ** k for k, p in enumerate(powers, 1)}), y, powers, by)


def residuals(df: DataFrame, y: str, xs: list[str], by: str = "symbol") -> DataFrame:
    """``df`` with ``fitted`` and ``residual``: the fit, one row per group, joined back."""
    fit = least_squares(df, y, xs, by).select(by, "beta")
    fitted = sum((F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)), F.col("beta")[0])
    return df.join(fit, by).withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("beta")


def residual_diagnostics(df: DataFrame, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Durbin-Watson and Jarque-Bera (excess kurtosis once) of the column ``residual``."""
    step = F.col("residual") - F.lag("residual").over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_d", step).groupBy(by).agg(F.count("residual").alias("n"), (F.sum(F.col("_d") ** 2) / F.sum(F.col("residual") ** 2)).alias("durbin_watson"), (F.count("residual") / 6.0 * (F.skewness("residual") ** 2 + F.kurtosis("residual") ** 2 / 4)).alias("jarque_bera"))


def breusch_pagan(df: DataFrame, y: str, xs: list[str], by: str = "symbol") -> DataFrame:
    """n R2 of the squared residuals on the regressors."""
    squared = residuals(df, y, xs, by).withColumn("_e2", F.col("residual") ** 2)
    return least_squares(squared, "_e2", xs, by).select(by, (F.col("n") * F.col("r2")).alias("statistic"))


def inflation(df: DataFrame, xs: list[str], by: str = "symbol") -> DataFrame:
    """Variance inflation factor of each regressor: 1 / (1 - R2) of it on the others."""
    out = None
    for x in xs:
        one = least_squares(df, x, [o for o in xs if o != x], by).select(by, F.lit(x).alias("factor"), (1 / (1 - F.col("r2"))).alias("vif"))
        out = one if out is None else out.unionByName(one)
    return out


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Durbin-Levinson recursion on each series' array of autocorrelations; adds ``pacf``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def recursion(arrays: pd.Series) -> pd.Series:
        out = []
        for r in arrays:
            phi, partial = [], []
            for k in range(len(r)):
                top = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
                bottom = 1 - sum(p * r[j] for j, p in enumerate(phi))
                now = top / bottom if bottom else 0.0
                phi = [p - now * q for p, q in zip(phi, phi[::-1])] + [now]
                partial.append(float(now))
            out.append(partial)
        return pd.Series(out)

    return acf.withColumn("pacf", recursion("acf"))


def adf(df: DataFrame, x: str, lags: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Augmented Dickey-Fuller statistic: the change on the level before it and ``lags`` earlier changes."""
    w = Window.partitionBy(by).orderBy(order)
    own = df.select(by, order, F.lag(x).over(w).alias("_level"), (F.col(x) - F.lag(x).over(w)).alias("_d"))
    own = own.select("*", *[F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, lags + 1)])
    fit = least_squares(own, "_d", ["_level", *[f"_d{k}" for k in range(1, lags + 1)]], by)
    return fit.select(by, "n", (F.col("beta")[1] / F.col("error")[0]).alias("statistic"))


def kpss(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Sum of squared running sums of deviations over n^2 times their variance."""
    mean = df.groupBy(by).agg(F.avg(x).alias("_m"))
    own = df.join(mean, by).select(by, order, (F.col(x) - F.col("_m")).alias("_e"))
    own = own.withColumn("_s", F.sum("_e").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count("*")
    return own.groupBy(by).agg(n.alias("n"), (F.sum(F.col("_s") ** 2) / (n * n * (F.sum(F.col("_e") ** 2) / n))).alias("statistic"))


def granger(df: DataFrame, cause: str, effect: str, lags: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """F statistic of adding ``lags`` lags of ``cause`` to as many of ``effect``; both fits use the same rows."""
    w = Window.partitionBy(by).orderBy(order)
    own_lags, other = [f"_y{k}" for k in range(1, lags + 1)], [f"_x{k}" for k in range(1, lags + 1)]
    table = df.select(by, F.col(effect).alias("_y"), *[F.lag(effect, k).over(w).alias(f"_y{k}") for k in range(1, lags + 1)], *[F.lag(cause, k).over(w).alias(f"_x{k}") for k in range(1, lags + 1)])
    small = least_squares(table.where(" and ".join(f"{c} is not null" for c in other)), "_y", own_lags, by).select(by, F.col("rss").alias("_r"))
    big = least_squares(table, "_y", own_lags + other, by)
    return big.join(small, by).select(by, "n", (((F.col("_r") - F.col("rss")) / lags) / (F.col("rss") / F.col("free"))).alias("f"))


def engle_granger(df: DataFrame, y: str, x: str, lags: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """ADF statistic of the residuals of y on x."""
    return adf(residuals(df, y, [x], by), "residual", lags, by, order)


def attribution(df: DataFrame, y: str, xs: list[str], by: str = "symbol") -> DataFrame:
    """Share of the variance of y that each factor explains: slope x covariance / variance, long form."""
    fit = least_squares(df, y, xs, by).select(by, "beta")
    moments = df.groupBy(by).agg(F.var_samp(y).alias("_v"), *[F.covar_samp(y, x).alias(f"_c{i}") for i, x in enumerate(xs)])
    parts = F.array(*[F.struct(F.lit(x).alias("factor"), F.col("beta")[i + 1].alias("beta"), (F.col("beta")[i + 1] * F.col(f"_c{i}") / F.col("_v")).alias("share")) for i, x in enumerate(xs)])
    return fit.join(moments, by).select(by, F.inline(parts))
