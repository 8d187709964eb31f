"""Calibration of probabilities: isotonic by pooling neighbours, temperature by folds in time order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Neighbouring score ranges that one task joins in a step up the tree.
FAN = 32


def pooled(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: for each block of rows (number, sum) in order of score, the first block of its pool."""
    starts: list[int] = []
    counts: list[float] = []
    sums: list[float] = []
    for i, (c, v) in enumerate(zip(n.tolist(), s.tolist())):
        starts.append(i)
        counts.append(c)
        sums.append(v)
        while len(sums) > 1 and sums[-2] * counts[-1] > sums[-1] * counts[-2]:
            c, v = counts.pop(), sums.pop()
            starts.pop()
            counts[-1] += c
            sums[-1] += v
    return np.repeat(starts, np.diff([*starts, len(n)]))


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo").reset_index(drop=True)
    first = pooled(rows["n"].to_numpy(float), rows["s"].to_numpy(float))
    return pd.DataFrame({"lo": rows["lo"], "pool": rows["lo"].to_numpy()[first], "part": rows["part"], "n": rows["n"], "s": rows["s"]})


def isotonic_breakpoints(df: DataFrame, p: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Isotonic fit of ``y`` on the score ``p``: the least score of each pool with its rate (``lo``, ``rate``, ``n``), and
    the pool of each distinct score (``score``, ``lo``).

    Pooling is the same whether neighbours are pooled before or after: distinct scores are pooled inside ranges of the
    score, and the pools of neighbouring ranges are pooled again, some ranges in a task, until one is left. What reaches
    the last task is pools, not scores.
    """
    x = F.col(p).cast("double")
    scores = stored(df.where(x.isNotNull() & F.col(y).isNotNull()).groupBy(x.alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")))
    shape = "lo double, pool double, part long, n long, s double"
    ranged = scores.repartitionByRange("lo").withColumn("part", F.spark_partition_id().cast("long"))

    def inside(batches):
        rows = [b for b in batches if len(b)]
        if rows:
            yield _pool(pd.concat(rows))

    found = stored(ranged.mapInPandas(inside, shape))
    members = found.select(F.col("lo").alias("score"), F.col("pool").alias("lo"))
    ranges = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        blocks = found.groupBy(F.col("pool").alias("lo")).agg(F.min("part").alias("part"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        if ranges == 1:
            break
        joined = blocks.withColumn("part", F.floor(F.col("part") / FAN))
        found = joined.groupBy("part").applyInPandas(_pool, shape)
        ranges = -(-ranges // FAN)
        members = members.join(found.select("lo", "pool"), "lo").select("score", F.col("pool").alias("lo"))
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.col("n")))
    return blocks.select("lo", rate.alias("rate"), "n"), members


def isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """Columns of ``df`` and ``calibrated``, the isotonic rate of the row's score; rows without a score or outcome have none."""
    points, members = isotonic_breakpoints(df, p, y)
    table = members.join(points, "lo").select(F.col("score").alias("_score"), F.col("rate").alias("calibrated"))
    own = df.withColumn("_score", F.when(F.col(y).isNotNull(), F.col(p).cast("double")))
    return own.join(table, "_score", "left").drop("_score")


def apply_isotonic(df: DataFrame, p: str, points: DataFrame) -> DataFrame:
    """Rates for scores that may be unseen: that of the last breakpoint at or below the score, or of the first one.

    Rows and breakpoints are sorted together by score over ranges; a range begins with the last breakpoint before it,
    from a table with one row a range.
    """
    columns = df.columns
    marks = points.select(F.col("lo").alias("_x"), F.col("rate").alias("_rate"))
    rows = df.select(F.struct(*columns).alias("_row"), F.col(p).cast("double").alias("_x"))
    both = marks.select("_x", "_rate", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")).unionByName(rows.withColumn("_rate", F.lit(None).cast("double")))
    placed = stored(both.repartitionByRange("_x").withColumn("_part", F.spark_partition_id()))
    so_far = Window.partitionBy("_part").orderBy("_x", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.groupBy("_part").agg(F.max_by("_rate", F.when(F.col("_rate").isNotNull(), F.col("_x"))).alias("_end"))
    before = ends.select("_part", F.last("_end", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    first = points.agg(F.min_by("rate", "lo").alias("_first"))
    seen = placed.withColumn("_own", F.last("_rate", True).over(so_far)).where(F.col("_row").isNotNull()).join(before, "_part").crossJoin(F.broadcast(first))  # one row
    rate = F.when(F.col("_x").isNotNull(), F.coalesce("_own", "_before", "_first"))
    return seen.select("_row.*", rate.alias("calibrated"))


#: Range of the temperature; coarse points, and fine points from one coarse point to the next.
LOWEST, HIGHEST, COARSE, FINE = 0.05, 20.0, 24, 20


def temperature_at(k: Column) -> Column:
    """The k-th point of the fine grid, from 0 to COARSE x FINE."""
    return LOWEST * F.pow(F.lit(HIGHEST / LOWEST), k.cast("double") / (COARSE * FINE))


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _scaled(logs: list[Column], t: Column) -> list[Column]:
    """Logarithms of the probabilities after division by the temperature."""
    z = [v / t for v in logs]
    top = F.greatest(*z)
    rest = top + F.log(_total([F.exp(v - top) for v in z]))
    return [v - rest for v in z]


def temperature_by_fold(df: DataFrame, classes: dict[str, int], y: str, by: list[str], fold: str = "fold", least: int = 50) -> DataFrame:
    """Temperature scaling fitted on earlier folds only and judged on the fold itself, for each group and fold.

    Each row adds its log loss at the points of a grid to its fold; running totals over the folds before give every
    fold's loss at every point, so a row is read once for all the folds after it. The loss is convex in the inverse
    temperature: a coarse grid brackets the least, and a second pass looks at the fine points around the brackets that
    some fold needs. Folds with fewer than ``least`` rows or one class before them have no temperature.
    ``classes``: probability column -> class. Returned: rows before and inside, temperature, and log loss and Brier
    score before and after scaling.
    """
    # a row's class and the logarithms of its clipped probabilities
    names = list(classes)
    own = df.where(F.col(y).isNotNull()).select(*by, fold, F.col(y).alias("_y"), *[F.log(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-15))).alias(f"_l{i}") for i, c in enumerate(names)])
    logs = [F.col(f"_l{i}") for i in range(len(names))]
    of_class = lambda values: _total([F.when(F.col("_y") == k, v).otherwise(0.0) for v, k in zip(values, classes.values())])
    earlier = Window.partitionBy(*by).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)

    counts = own.groupBy(*by, fold).agg(F.count("*").alias("n"), F.collect_set("_y").alias("_c"))
    known = counts.select(*by, fold, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.size(F.array_distinct(F.flatten(F.collect_list("_c").over(earlier)))).alias("_classes"))

    def best(rows: DataFrame) -> DataFrame:
        """Least point of each fold, from (row, _k): losses by fold and point, then totals of the folds before."""
        at = rows.groupBy(*by, fold, "_k").agg(F.sum(-of_class(_scaled(logs, temperature_at(F.col("_k"))))).alias("_loss"))
        # every fold has the same points within its group, so totals run over folds point by point
        before = at.withColumn("_before", F.sum("_loss").over(Window.partitionBy(*by, "_k").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)))
        return before.where("_before is not null").groupBy(*by, fold).agg(F.min_by("_k", F.struct("_before", "_k")).alias("_k"))

    coarse = own.withColumn("_k", F.explode(F.array(*[F.lit(i * FINE) for i in range(COARSE + 1)])))
    fitted = known.where((F.col("n_before") >= least) & (F.col("_classes") >= 2))
    brackets = best(coarse).join(fitted.select(*by, fold), [*by, fold], "left_semi")
    around = F.sequence(F.greatest(F.col("_k") - FINE, F.lit(0)), F.least(F.col("_k") + FINE, F.lit(COARSE * FINE)))
    points = brackets.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(around)))).alias("_points"))
    fine = own.join(points, by).withColumn("_k", F.explode("_points")).drop("_points")
    chosen = best(fine).join(fitted.select(*by, fold), [*by, fold], "left_semi").withColumn("temperature", temperature_at(F.col("_k"))).drop("_k")

    judged = own.join(chosen, [*by, fold], "left")
    raw, scaled = _scaled(logs, F.lit(1.0)), _scaled(logs, F.col("temperature"))
    brier = lambda z: F.avg(_total([(F.exp(v) - F.when(F.col("_y") == k, 1.0).otherwise(0.0)) ** 2 for v, k in zip(z, classes.values())]))
    scores = judged.groupBy(*by, fold).agg(F.max("temperature").alias("temperature"), F.avg(-of_class(raw)).alias("raw_log_loss"), F.avg(-of_class(scaled)).alias("log_loss"), brier(raw).alias("raw_brier"), brier(scaled).alias("brier"))
    return known.select(*by, fold, "n_before", "n").join(scores, [*by, fold])
