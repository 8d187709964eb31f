"""Relations between macro series, regimes by vote, and findings over result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.blocks import base, reads
from tidemark.operators.stats import relation_type, strength
from tidemark.operators.windows import corr


def pairs(df: DataFrame, of: str) -> DataFrame:
    """Values of each pair of series at the times that both have: a, b, ts, x, y. Series meet by time."""
    left = df.select("ts", F.col("symbol").alias("a"), F.col(of).alias("x"))
    right = df.select("ts", F.col("symbol").alias("b"), F.col(of).alias("y"))
    return left.join(right, "ts").where("a < b").select("a", "b", "ts", "x", "y")


def compare_halves(df: DataFrame) -> DataFrame:
    """Correlation in the earlier and the later half of each pair's rows, and the kind of break between them."""
    w = Window.partitionBy("a", "b")
    own = df.select("*", (F.row_number().over(w.orderBy("ts")) <= F.floor(F.count("*").over(w) / 2)).alias("_early"))
    part = lambda early: corr(F.when(F.col("_early") == early, F.col("x")), F.when(F.col("_early") == early, F.col("y")))
    got = own.groupBy("a", "b").agg(part(True).alias("before"), part(False).alias("after"))
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    return got.withColumn("break_type", F.when(known & (F.col("before") * F.col("after") < 0), "direction_change").when(known, "strength_change"))


def pair_analysis(df: DataFrame, high: Column) -> DataFrame:
    """Every pair in one aggregate: correlation, covariance, slope, and the correlation in and out of a regime."""
    part = lambda c: corr(F.when(c, F.col("x")), F.when(c, F.col("y")))
    got = df.groupBy("a", "b").agg(F.count("*").alias("n"), corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("covar"), F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("beta"), part(high).alias("corr_high"), part(~high).alias("corr_low"))
    return got.select("*", relation_type(F.col("corr")).alias("type"), strength(F.col("corr")).alias("strength"))


def regime_votes(df: DataFrame, of: str, w: int = 20, short: int = 5, back: int = 10) -> DataFrame:
    """Level, trend and momentum each vote 1, 0 or -1; two votes more for one side name the regime, and the share of
    votes is its confidence. A missing value votes 0."""
    sign = lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0)
    own = df.select("symbol", "ts", F.col(of).alias("v"), W.sma(of, w).alias("_m"), W.sma(of, short).alias("_s"), W.previous(of, back).alias("_b"))
    own = own.select("symbol", "ts", sign(F.col("v"), F.col("_m")).alias("level"), sign(F.col("_s"), F.col("_m")).alias("trend"), sign(F.col("v"), F.col("_b")).alias("momentum"))
    total = F.col("level") + F.col("trend") + F.col("momentum")
    return own.select("*", F.when(total >= 2, "expansion").when(total <= -2, "contraction").otherwise("mixed").alias("regime"), (F.abs(total) / 3).alias("confidence"))


def regime_transitions(df: DataFrame) -> DataFrame:
    """Rows at which the regime changes: what it was before and for how many rows it had held."""
    own = df.select("symbol", "ts", "regime", F.lag("regime").over(W.series()).alias("previous"), F.row_number().over(W.series()).alias("_k"))
    change = own.where(F.col("previous").isNull() | (F.col("previous") != F.col("regime")))
    return change.withColumn("held", (F.col("_k") - F.lag("_k").over(W.series())).cast("long")).where(F.col("previous").isNotNull()).select("symbol", "ts", "previous", "regime", "held")


#: Fixed values of early warnings: least probability of the change, least confidence and least strength of the votes.
LIKELY, CONFIDENT, STRONG, HORIZON = 0.15, 0.5, 0.3, 12


def early_warnings(df: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Warnings of a change from the last regime of each series: to each regime that followed it before in at least 15 %
    of the cases, with a confidence of that share times the strength of the present votes, and the rows until then that
    strength and confidence let expect. ``df``: symbol, ts, regime, confidence (:func:`regime_votes`)."""
    pairs = _followed(df)
    counts = pairs.groupBy("symbol", "regime", "_next").agg(F.count("*").alias("_n"))
    totals = pairs.groupBy("symbol", "regime").agg(F.count("*").alias("_all"))
    now = df.groupBy("symbol").agg(F.max_by(F.struct("regime", F.col("confidence").alias("strength")), "ts").alias("_l")).select("symbol", "_l.*")
    p = F.col("_n") / F.col("_all")
    found = now.join(counts, ["symbol", "regime"]).join(totals, ["symbol", "regime"]).where((F.col("_next") != F.col("regime")) & (p >= LIKELY))
    found = found.withColumn("probability", p).withColumn("confidence", F.col("probability") * F.col("strength"))
    horizon = F.greatest(F.lit(2), F.floor(HORIZON * (1 - (F.col("strength") * 0.4 + F.col("confidence") * 0.3))).cast("int"))
    return found.where((F.col("confidence") >= least) & (F.col("strength") >= STRONG)).select("symbol", "regime", F.col("_next").alias("expected"), "probability", "confidence", horizon.alias("horizon"))


@reads(0, 1)
def _followed(df: DataFrame) -> DataFrame:
    """Regimes and what followed each."""
    return df.select(*base(df), "regime", F.lead("regime").over(W.series()).alias("_next")).where("_next is not null")


def findings(halves: DataFrame, series: DataFrame, of: str, break_at: float = 0.5, persistent_at: float = 0.2, z_at: float = 2.0) -> DataFrame:
    """Correlation breaks, persistent relations and anomalous values as rows: kind, subject, strength."""
    pair = F.concat_ws("/", "a", "b")
    gap, least = F.abs(F.col("before") - F.col("after")), F.least(F.abs("before"), F.abs("after"))
    known = halves.where("before is not null and after is not null")
    breaks = known.where(gap >= break_at).select(F.lit("correlation_break").alias("kind"), pair.alias("subject"), gap.alias("strength"))
    lasting = known.where((F.col("before") * F.col("after") > 0) & (least >= persistent_at)).select(F.lit("persistent_relation").alias("kind"), pair.alias("subject"), least.alias("strength"))
    stats = series.groupBy("symbol").agg(F.avg(of).alias("_m"), F.stddev_samp(of).alias("_s"))
    z = F.abs(F.try_divide(F.col(of) - F.col("_m"), F.col("_s")))
    odd = series.join(F.broadcast(stats), "symbol").where(z >= z_at).select(F.lit("anomaly").alias("kind"), F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd")).alias("subject"), z.alias("strength"))
    return reduce(DataFrame.unionByName, [breaks, lasting, odd])
