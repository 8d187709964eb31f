"""Exact elements of a sorted group, without sorting it.

Values are counted in equal bins between a lower and an upper bound; only the bin that holds the wanted rank is looked at
again, with its own bounds, until it holds few rows or one value. Each look is an aggregate of all groups at once; no
task holds a group, and no row is shuffled before few are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Bins of one look, and rows of a group that are then sorted.
BINS, FEW = 1024, 4096


def elements(df: DataFrame, x: str, ranks: dict[str, Column], by: str = "symbol", few: int = FEW) -> DataFrame:
    """Per group: by, n, and for each name the element of the ascending values at a 0-based rank, a column of ``n``.

    Nulls and values that are not finite are left out; a rank outside the group gives null.
    """
    rows = df.select(F.col(by), F.col(x).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    sizes = stored(rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = sizes.select(by, "lo", "hi", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()])))
    # ``before``: rows of the group below lo; ``held``: rows within [lo, hi]
    wanted = stored(wanted.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select(by, "name", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("held")))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    while True:
        wide = wanted.where((F.col("held") > few) & (F.col("hi") > F.col("lo")))
        if wide.isEmpty():
            break
        inside = rows.join(wide, by).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # bounds in the bins' own values keep every round exact; a range too narrow for bins ends at its lower value
        bins = inside.groupBy(by, "name", "rank", "before", place.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up_to = F.sum("held").over(Window.partitionBy(by, "name").orderBy("bin"))
        found = bins.withColumn("before", F.col("before") + up_to - F.col("held")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))
        narrowed = found.select(*wanted.columns)
        wanted = stored(wanted.join(wide.select(by, "name"), [by, "name"], "left_anti").unionByName(narrowed))
    few_rows = rows.join(wanted.where(F.col("hi") > F.col("lo")), by).where(F.col("v").between(F.col("lo"), F.col("hi")))
    at = F.row_number().over(Window.partitionBy(by, "name").orderBy("v")) - 1  # ``few`` rows at most
    sorted_ = few_rows.withColumn("_at", at + F.col("before")).where(F.col("_at") == F.col("rank")).select(by, "name", "v")
    single = wanted.where(F.col("hi") == F.col("lo")).select(by, "name", F.col("lo").alias("v"))
    values = sorted_.unionByName(single).groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])
    return sizes.select(by, "n").join(values, by, "left")


def quantiles(df: DataFrame, x: str, shares: dict[str, float], by: str = "symbol") -> DataFrame:
    """Interpolated quantiles per group, exact: the value at (n - 1) q between its two neighbours."""
    ranks = {}
    for k, q in shares.items():
        ranks |= {f"_a_{k}": F.floor((F.col("n") - 1) * q), f"_b_{k}": F.ceil((F.col("n") - 1) * q)}
    got = elements(df, x, ranks, by)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return got.select(by, "n", *[(F.col(f"_a_{k}") + part(q) * (F.col(f"_b_{k}") - F.col(f"_a_{k}"))).alias(k) for k, q in shares.items()])
