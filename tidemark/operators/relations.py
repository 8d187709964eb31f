"""Relations between series, breaks in them, event studies and small per-group measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.laws import binomial_tail
from tidemark.operators.windows import corr, series


def regime_correlation(df: DataFrame, x: str, y: str, regime: str, minimum: int, by: str = "symbol") -> DataFrame:
    return df.groupBy(by, regime).agg(F.when(F.count("*") >= minimum, corr(x, y)).alias("corr"), F.count("*").alias("n"))


def sign_test(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Paired sign test: cases that only ``a`` or only ``b`` gets right, with the exact two-sided binomial p-value, whose
    tail is an incomplete beta function."""
    own = df.groupBy(by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("wins"), F.count_if(F.col(b) & ~F.col(a)).alias("losses"))
    n, k = F.col("wins") + F.col("losses"), F.greatest("wins", "losses")
    return own.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, k))))


def beta_posterior(df: DataFrame, hit: str, by: str, a: float = 1.0, b: float = 1.0) -> DataFrame:
    own = df.where(F.col(hit).isNotNull()).groupBy(by).agg((F.count_if(F.col(hit)) + F.lit(a)).alias("a"), (F.count_if(~F.col(hit)) + F.lit(b)).alias("b"))
    return own.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def event_study(df: DataFrame, cost: float) -> DataFrame:
    """By year and direction and over all years, gross and net of cost: one aggregate with grouping sets."""
    own = df.select(F.year("ts").cast("string").alias("year"), "direction", "fwd")
    sets = own.groupingSets([["year", "direction"], ["direction"]], "year", "direction").agg(F.count("*").alias("n"), F.avg("fwd").alias("gross"), F.avg(F.col("fwd") - cost).alias("net"), F.avg((F.col("fwd") - cost > 0).cast("double")).alias("win_rate"))
    return sets.withColumn("year", F.coalesce("year", F.lit("ALL")))


def seasonality(df: DataFrame, r: str, period: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Mean and hit rate by row number modulo ``period``."""
    own = df.where(F.col(r).isNotNull()).select(by, r, ((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) % period).cast("long").alias("season"))
    return own.groupBy(by, "season").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.avg((F.col(r) > 0).cast("double")).alias("hit"))


def session(ts):
    """Fixed hours in UTC: Asian to 8, European to 16, Overlap to 21, then US."""
    return F.when(F.hour(ts) < 8, "Asian").when(F.hour(ts) < 16, "European").when(F.hour(ts) < 21, "Overlap").otherwise("US")


def sessions(bars: DataFrame) -> DataFrame:
    move = F.col("close") - F.col("open")
    share = lambda c: F.avg(c.cast("double"))
    return bars.groupBy(session("ts").alias("session")).agg(F.count("*").alias("n"), F.avg(move).alias("mean"), F.stddev_samp(move).alias("sd"), share(move > 0).alias("positive"), share(move < 0).alias("negative"), share(move == 0).alias("flat"))


def surprise(actual, forecast):
    """(actual - forecast) / |forecast|; 0 where the forecast is 0, null where one is missing."""
    return F.when(forecast == 0, F.when(actual.isNotNull(), 0.0)).otherwise((actual - forecast) / F.abs(forecast))


def classify_surprise(value, band: float = 0.01):
    return F.when(value > band, "positive").when(value < -band, "negative").when(value.isNotNull(), "neutral")


def surprises(df: DataFrame, by: str, band: float = 0.01) -> DataFrame:
    """Surprises summarised per series."""
    own = df.withColumn("_s", surprise(F.col("actual"), F.col("forecast"))).where("_s is not null").withColumn("_k", classify_surprise(F.col("_s"), band))
    return own.groupBy(by).agg(F.count("*").alias("n"), F.avg("_s").alias("mean"), F.avg(F.abs("_s")).alias("mean_abs"), F.count_if(F.col("_k") == "positive").alias("above"), F.count_if(F.col("_k") == "negative").alias("below"))


def divergence(both: DataFrame, by: str = "symbol") -> DataFrame:
    gap = F.col("a") - F.col("b")
    q = lambda p: F.percentile(F.abs(gap), F.lit(p))
    return both.groupBy(by).agg(F.count("*").alias("n"), F.avg(gap).alias("mean"), F.avg(F.abs(gap)).alias("mean_abs"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.count_if(gap > 0).alias("above"), F.count_if(gap < 0).alias("below"))


def daily_divergence(both: DataFrame) -> DataFrame:
    """The same gaps by day: rows, mean, mean and greatest size."""
    gap = F.col("a") - F.col("b")
    return both.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg(gap).alias("mean"), F.avg(F.abs(gap)).alias("mean_abs"), F.max(F.abs(gap)).alias("most"))


def correlations_with(df: DataFrame, r: str, target: str) -> DataFrame:
    """Correlation of every series' returns with those of one, at common times."""
    own = df.where(F.col(r).isNotNull()).select("symbol", "ts", F.col(r).alias("_r"))
    one = own.where(F.col("symbol") == target).select("ts", F.col("_r").alias("_t"))
    return own.where(F.col("symbol") != target).join(one, "ts").groupBy("symbol").agg(F.count("*").alias("n"), corr("_r", "_t").alias("corr"))


def optimal_lag(df: DataFrame, a: str, b: str, most: int, by: str = "symbol") -> DataFrame:
    """The lag of ``b`` behind ``a`` (rows, -most to most) with the greatest absolute correlation. ``df`` has ``idx``."""
    left = df.select(by, "idx", F.col(a).alias("_a")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("idx", F.col("idx") + F.col("lag"))
    both = left.join(df.select(by, "idx", F.col(b).alias("_b")), [by, "idx"]).groupBy(by, "lag").agg(corr("_a", "_b").alias("corr"), F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc(F.abs("corr")), F.abs("lag"), "lag")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, "lag", "corr", "n")


def mean_shift(df: DataFrame, x: str, critical: float = 2.0) -> DataFrame:
    """The split between the first and the last quarter of the rows with the greatest difference of means over its
    standard error, from running sums; a break if that passes ``critical``. Values are centred first; equal statistics
    go to the earlier split. Per series: idx (first row of the second part), ts, statistic, has_break."""
    so_far, whole = series().rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("symbol")
    own = df.select("symbol", "ts", (F.col(x) - F.avg(x).over(whole)).alias("v"))
    own = own.select("symbol", "ts", (F.row_number().over(series()) - 1).alias("k"), F.count("*").over(whole).alias("n"), *[F.sum(v).over(w).alias(f"{t}_{p}") for t, v in (("s", F.col("v")), ("q", F.col("v") ** 2)) for p, w in (("a", so_far), ("t", whole))])
    a, b = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    own = own.where((F.col("k") >= F.floor(F.col("n") / 4)) & (F.col("k") < F.floor(3 * F.col("n") / 4)) & (F.col("k") > 0))
    m1, m2 = F.col("s_a") / a, (F.col("s_t") - F.col("s_a")) / b
    pooled = F.greatest((F.col("q_a") / a - m1**2 + (F.col("q_t") - F.col("q_a")) / b - m2**2) / 2, F.lit(0.0))
    own = own.withColumn("statistic", F.coalesce(F.try_divide(F.abs(m1 - m2), F.sqrt(pooled * (1 / a + 1 / b))), F.lit(0.0)))
    best = own.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("statistic"), "k"))).where("_r = 1")
    return best.select("symbol", F.col("k").cast("long").alias("idx"), "ts", "statistic", (F.col("statistic") > critical).alias("has_break"))


def correlation_break(df: DataFrame, x: str, y: str, least: int) -> DataFrame:
    """The point with the greatest difference of the correlations before and after it, from running sums of centred
    products: linear in the rows."""
    whole, so_far = Window.partitionBy("symbol"), series().rowsBetween(Window.unboundedPreceding, 0)
    own = df.select("symbol", "ts", (F.col(x) - F.avg(x).over(whole)).alias("x"), (F.col(y) - F.avg(y).over(whole)).alias("y"))
    terms = {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") ** 2, "yy": F.col("y") ** 2, "xy": F.col("x") * F.col("y")}
    own = own.select("symbol", "ts", F.row_number().over(series()).alias("k"), F.count("*").over(whole).alias("n"), *[F.sum(v).over(so_far).alias(f"s_{t}") for t, v in terms.items()], *[F.sum(v).over(whole).alias(f"t_{t}") for t, v in terms.items()])

    def corr(n, s):
        return (n * s("xy") - s("x") * s("y")) / F.sqrt((n * s("xx") - s("x") ** 2) * (n * s("yy") - s("y") ** 2))

    before = corr(F.col("k"), lambda t: F.col(f"s_{t}"))
    after = corr(F.col("n") - F.col("k"), lambda t: F.col(f"t_{t}") - F.col(f"s_{t}"))
    own = own.where((F.col("k") >= least) & (F.col("n") - F.col("k") >= least)).select("symbol", "ts", F.abs(before - after).alias("gap"))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("gap"), "ts"))).where("_r = 1").drop("_r")
