"""Validation folds, multiple testing and resampling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def expanding_folds(spark: SparkSession, n: int, initial: int, step: int) -> DataFrame:
    """scheme, fold, train_lo, train_hi, test_lo, test_hi (half-open row numbers); training grows from row 0."""
    k = max(0, -(-(n - initial) // step))
    fold = F.col("id").cast("int")
    lo = F.lit(initial) + F.col("id") * step
    return spark.range(k).select(fold.alias("fold"), F.lit(0).cast("long").alias("train_lo"), lo.alias("train_hi"), lo.alias("test_lo"), F.least(lo + step, F.lit(n)).alias("test_hi"))


def expanding_folds_of(rows: DataFrame, initial: int, step: int, by: str = "symbol") -> DataFrame:
    """The folds of every series, by its own number of rows."""
    sized = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > initial)
    many = sized.select(by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - initial - 1) / step))).alias("_k"))
    lo = F.lit(initial) + F.col("_k") * step
    return many.select(by, F.col("_k").cast("int").alias("fold"), F.lit(0).cast("long").alias("train_lo"), lo.alias("train_hi"), lo.alias("test_lo"), F.least(lo + step, F.col("_n")).alias("test_hi"))


def purged_folds(rows: DataFrame, k: int, purge: int, embargo: int, by: str = "symbol") -> DataFrame:
    """k equal test blocks of every series, by its own number of rows; training is what lies before less ``purge`` rows
    and after plus ``purge`` and ``embargo`` rows."""
    sized = rows.groupBy(by).agg(F.count("*").alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    n, fold = F.col("_n"), F.col("fold").cast("long")
    lo, hi = F.floor(fold * n / k), F.floor((fold + 1) * n / k)
    return sized.select(by, "fold", lo.alias("test_lo"), hi.alias("test_hi"), F.greatest(lo - purge, F.lit(0)).alias("before_hi"), F.least(hi + purge + embargo, n).alias("after_lo"))


def assign_purged(rows: DataFrame, folds: DataFrame, by: str = "symbol") -> DataFrame:
    """Each (row, fold) with its role; rows in the purge or embargo zone have none. The fold table has k rows a series."""
    i = F.col("idx")
    role = F.when((i >= F.col("test_lo")) & (i < F.col("test_hi")), "test").when((i < F.col("before_hi")) | (i >= F.col("after_lo")), "train")
    return rows.join(folds, by).withColumn("role", role).where(F.col("role").isNotNull())


def chronological_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, by: str = "symbol", order: str = "ts") -> DataFrame:
    k, n = F.row_number().over(Window.partitionBy(by).orderBy(order)), F.count("*").over(Window.partitionBy(by))
    own = df.select("*", k.alias("_k"), n.alias("_n"))
    a = F.floor(F.col("_n") * train)
    b = a + F.floor(F.col("_n") * validation)
    return own.withColumn("split", F.when(F.col("_k") <= a, "train").when(F.col("_k") <= b, "validation").otherwise("test")).drop("_k", "_n")


def majority(df: DataFrame, label: str, by: str) -> DataFrame:
    """Most frequent class per group; ties go to the greater class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.desc(label))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, F.col(label).alias("majority"), "n", )


def totals_before(rows: DataFrame, at: str, folds: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows whose time ``at`` lies before each fold's ``cutoff``: fold, the columns ``by``, the sums.

    Rows are summed by day first; days before the cutoff's own day count as a whole, and only rows of that day are
    compared one by one. So the work grows with the rows plus days x folds, not with rows x folds. ``folds``: fold, cutoff.
    """
    days = rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("_day"), *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cut = folds.select("fold", "cutoff", F.to_date("cutoff").alias("_cut"))
    whole = days.join(cut, F.col("_day") < F.col("_cut")).select("fold", *by, *sums)
    last = rows.withColumn("_cut", F.to_date(at)).join(cut, "_cut").where(F.col(at) < F.col("cutoff")).select("fold", *by, *[c.alias(n) for n, c in sums.items()])
    return whole.unionByName(last).groupBy("fold", *by).agg(*[F.sum(n).alias(n) for n in sums])


def prior_rate(events: DataFrame, folds: DataFrame) -> DataFrame:
    """Hit rate per fold and direction from events whose outcome was realised before the fold's start.

    ``events``: ts, realized_end (not before ts), direction, hit; ``folds``: fold, start, stop, in time order and
    without overlap (few rows).
    """
    sums = {"n_train": F.when(F.col("realized_end").isNotNull(), 1).cast("long"), "_known": F.col("hit").isNotNull().cast("long"), "_hits": F.coalesce(F.col("hit").cast("long"), F.lit(0).cast("long"))}
    train = totals_before(events, "realized_end", folds.select("fold", F.col("start").alias("cutoff")), ["direction"], sums).select("fold", "direction", "n_train", F.try_divide("_hits", "_known").alias("p"))
    test = events.join(folds, (events["ts"] >= folds["start"]) & (events["ts"] < folds["stop"])).groupBy("fold", "direction").agg(F.count("*").alias("n_test"), F.avg(F.col("hit").cast("double")).alias("observed"))
    return train.join(test, ["fold", "direction"])


def adjust_p_values(df: DataFrame, p: str = "p", tie: str = "name") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values of one family of tests (a small table)."""
    all_rows, w = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(p, tie)
    own = df.select("*", F.row_number().over(w).alias("_k"), F.count("*").over(all_rows).alias("_m"))
    one = F.lit(1.0)
    own = own.select("*", F.least(one, F.col(p) * F.col("_m")).alias("bonferroni"), (F.col(p) * (F.col("_m") - F.col("_k") + 1)).alias("_holm"), (F.col(p) * F.col("_m") / F.col("_k")).alias("_bh"))
    up = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return own.select(*df.columns, "bonferroni", F.least(one, F.max("_holm").over(up)).alias("holm"), F.least(one, F.min("_bh").over(down)).alias("benjamini_hochberg"))


def rows_of_folds(rows: DataFrame, initial: int, step: int, by: str = "symbol") -> DataFrame:
    """Test rows of expanding folds, by their number in the series: the fold follows from ``idx`` alone, so that the
    join of rows to fold bounds is a projection."""
    own = rows.where(F.col("idx") >= initial)
    return own.withColumn("fold", F.floor((F.col("idx") - initial) / step).cast("int"))
