"""Statistics per series or group. Deviations are sample or population as each function says."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.laws import normal_tail, t_tail
from tidemark.operators.windows import corr


def descriptive(df: DataFrame, x: str, by: str = "symbol") -> DataFrame:
    """Count, mean, median, variances, skew (plain and adjusted), excess kurtosis, extremes and quartiles."""
    n = F.count(x).cast("double")
    q = lambda p: F.percentile(x, F.lit(p))
    return df.groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), q(0.5).alias("median"), F.var_samp(x).alias("var_samp"), F.var_pop(x).alias("var_pop"), F.skewness(x).alias("skew"), (F.skewness(x) * n * n / ((n - 1) * (n - 2))).alias("skew_adjusted"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("lo"), F.max(x).alias("hi"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr")
    )


def histogram(df: DataFrame, x: str, bins: int, by: str = "symbol") -> DataFrame:
    """Equal-width bins from the least to the greatest value of each series; the last bin holds the greatest."""
    ends = df.groupBy(by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)))
    return df.where(F.col(x).isNotNull()).join(ends, by).groupBy(by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pearson_matrix(wide: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise correlations and covariances in long form, from one aggregate of one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr"), F.covar_samp(a, b).alias("covar"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n")).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.col(f"`{a}|{b}`") for a, b in pairs])))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.8, "very_strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").when(size.isNotNull(), "negligible")


def relation_type(r: Column) -> Column:
    return F.when(r > 0.05, "positive").when(r < -0.05, "negative").when(r.isNotNull(), "neutral")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by its t statistic: Student's law, from 30 degrees of freedom on the normal one;
    null for r = +-1 and for less than three pairs."""
    t = F.abs(r) * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    return F.when((n >= 3) & (F.abs(r) < 1), t_tail(t, n - 2))


def average_rank(x: str, by: str) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(by).orderBy(x)) + (F.count("*").over(Window.partitionBy(by, x)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: str = "symbol") -> DataFrame:
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return own.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by)).groupBy(by).agg(corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def regression(df: DataFrame, y: str, x: str, by: str = "symbol") -> DataFrame:
    """Least squares of y on x: slope, intercept, R2, residual deviation (n - 2)."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"))
    rest = F.greatest(F.col("_syy") - F.col("_sxy") ** 2 / F.col("_sxx"), F.lit(0.0))
    return fit.select(by, "n", "slope", "intercept", "r2", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).alias("residual_sd"))


def conditional(df: DataFrame, x: str, by: str, minimum: int = 5) -> DataFrame:
    """Count, share above zero, mean and population deviation of finite values; status by sample size."""
    own = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col(x) > 0).cast("double")).alias("p_up"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")).withColumn("status", F.when(F.col("n") >= minimum, "ok").otherwise("insufficient"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of k of n; null for n = 0."""
    p, q = F.try_divide(k, n), F.try_divide(F.lit(z * z), n)
    mid = (p + q / 2) / (1 + q)
    half = z / (1 + q) * F.sqrt(F.try_divide(p * (1 - p) + q / 4, n))
    return mid - half, mid + half


def confusion(df: DataFrame, actual: str, predicted: str, by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 per group; empty ratios are 0."""
    both = lambda a, p: F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).cast("double")
    got = df.groupBy(by).agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    got = got.select(by, "tp", "fp", "fn", "tn", safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return got.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def errors(df: DataFrame, actual: str, predicted: str, by: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg((F.signum(actual) == F.signum(predicted)).cast("double")).alias("directional"))


def probability_scores(df: DataFrame, p: str, actual: str, by: str) -> DataFrame:
    """Brier score and log loss (p clipped by 1e-15)."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    return df.groupBy(by).agg(F.avg((F.col(p) - F.col(actual)) ** 2).alias("brier"), F.avg(-(F.col(actual) * F.log(clipped) + (1 - F.col(actual)) * F.log(1 - clipped))).alias("log_loss"))


def reliability(df: DataFrame, p: str, actual: str, by: str, bins: int = 10) -> DataFrame:
    """Populated bins only: count, midpoint, observed share and their difference."""
    place = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins).cast("int"))
    out = df.groupBy(by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(actual).cast("double")).alias("observed"))
    return out.withColumn("midpoint", (F.col("bin") + 0.5) / bins).withColumn("gap", F.abs(F.col("observed") - F.col("midpoint")))


def entropy(df: DataFrame, x: str, y: str) -> DataFrame:
    """Entropy in bits of two discrete columns and their mutual information, from the joint counts alone."""
    joint = df.groupBy(x, y).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    p = joint.select(x, y, (F.col("n") / total).alias("p"), F.sum("n").over(Window.partitionBy(x)).alias("_nx"), F.sum("n").over(Window.partitionBy(y)).alias("_ny"), total.alias("_t"))
    px, py = F.col("_nx") / F.col("_t"), F.col("_ny") / F.col("_t")
    return p.agg((-F.sum(F.col("p") * F.log2(px))).alias("h_x"), (-F.sum(F.col("p") * F.log2(py))).alias("h_y"), F.sum(F.col("p") * F.log2(F.col("p") / (px * py))).alias("mutual_information"))


def mean_tests(df: DataFrame, x: str, by: str | list[str], mu: float = 0.0, sigma: float | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Tests of a mean against ``mu``: t statistic and its p-value (n - 1 degrees of freedom), z statistic for a known
    deviation ``sigma`` (the population's of the group unless given) and its p-value, effect size, and a normal interval
    of the mean. Statistics are null where nothing varies, t for fewer than two values."""
    by = [by] if isinstance(by, str) else by
    own = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"), F.stddev_pop(x).alias("_sd0"))
    root, known = F.sqrt("n"), F.col("_sd0") if sigma is None else F.lit(float(sigma))
    se = F.try_divide(F.col("sd"), root)
    own = own.withColumns({"t": F.try_divide(F.col("mean") - mu, se), "z": F.try_divide((F.col("mean") - mu) * root, known), "effect": F.try_divide(F.col("mean") - mu, F.col("sd")), "lo": F.col("mean") - z * se, "hi": F.col("mean") + z * se})
    return own.select(*by, "n", "mean", "sd", "t", t_tail(F.col("t"), F.col("n") - 1).alias("t_p"), "z", normal_tail(F.col("z")).alias("z_p"), "effect", "lo", "hi")


def log_normal(df: DataFrame, x: str, by: str) -> DataFrame:
    own = df.where(F.col(x) > 0)
    return own.groupBy(by).agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sigma"), F.avg(F.log(x)).alias("log_mu"), F.stddev_samp(F.log(x)).alias("log_sigma"))


def density(df: DataFrame, x: str, grid: list[float], width: float, by: str) -> DataFrame:
    """Empirical distribution function and Gaussian kernel density at fixed grid points: one aggregate, no join."""
    at = lambda g: F.struct(F.lit(g).alias("at"), F.avg((F.col(x) <= g).cast("double")).alias("cdf"), (F.avg(F.exp(-0.5 * ((F.col(x) - g) / width) ** 2)) / (width * math.sqrt(2 * math.pi))).alias("density"))
    return df.groupBy(by).agg(*[at(float(g)).alias(f"g{i}") for i, g in enumerate(grid)]).select(by, F.inline(F.array(*[f"g{i}" for i in range(len(grid))])))


def transitions(df: DataFrame, state: str, states: list, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Probabilities of the next state; a state that is never left has a uniform row."""
    pairs = df.select(by, F.col(state).alias("from"), F.lead(state).over(Window.partitionBy(by).orderBy(order)).alias("to")).where("`to` is not null")
    counts = pairs.groupBy(by, "from", "to").agg(F.count("*").alias("n"))
    grid = df.select(by).distinct().withColumn("from", F.explode(F.array(*map(F.lit, states)))).withColumn("to", F.explode(F.array(*map(F.lit, states))))
    both = grid.join(counts, [by, "from", "to"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(by, "from"))
    return both.select(by, "from", "to", "n", F.when(total == 0, 1.0 / len(states)).otherwise(F.col("n") / total).alias("p"))


def streaks(df: DataFrame, x: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Runs of equal sign: by, start, length, sign, and whether the run is still open at the end."""
    w = Window.partitionBy(by).orderBy(order)
    own = df.where(F.col(x).isNotNull()).select(by, order, F.signum(x).cast("int").alias("sign"))
    own = own.withColumn("_new", (F.lag("sign").over(w).isNull() | (F.col("sign") != F.lag("sign").over(w))).cast("int"))
    own = own.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = own.groupBy(by, "run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.first("sign").alias("sign"))
    return out.withColumn("is_open", F.col("run") == F.max("run").over(Window.partitionBy(by)))


def patterns(df: DataFrame, x: str, n: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Frequencies of up/down patterns of ``n`` steps. Window starts number rows - n, one fewer than possible."""
    w = Window.partitionBy(by).orderBy(order)
    letter = lambda k: F.when(F.lead(x, k).over(w) > 0, "U").when(F.lead(x, k).over(w).isNotNull(), "D")
    own = df.where(F.col(x).isNotNull()).select(by, F.concat(*[letter(k) for k in range(n)]).alias("pattern"), F.lead(x, n).over(w).alias("_after"))
    counts = own.where(F.col("_after").isNotNull()).groupBy(by, "pattern").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def autocorrelation(df: DataFrame, x: str, lags: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Autocorrelations at 1..lags about the series mean, and the Ljung-Box Q: centred lag products in one aggregate."""
    w = Window.partitionBy(by).orderBy(order)
    mean = df.groupBy(by).agg(F.avg(x).alias("_m"))
    own = df.where(F.col(x).isNotNull()).join(mean, by).select(by, order, (F.col(x) - F.col("_m")).alias("_c"))
    own = own.select("*", *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)])
    sums = own.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, lags + 1)])
    out = sums.select(by, "n", F.array(*[F.col(f"_s{k}") / F.col("_s0") for k in range(1, lags + 1)]).alias("acf"))
    q = F.aggregate(F.transform("acf", lambda r, i: r * r / (F.col("n") - i - 1)), F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * q)
