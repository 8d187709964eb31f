"""Decision trees of many groups at once (series, folds): one aggregate a level for all of them.

Features are cut into equal bins of the group's training range. A level counts classes by (group, node, feature, bin);
running counts over the few bins give every split's impurity, and the best split of each node sends its rows on. The
number of jobs follows the depth, not the number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored


@dataclass(frozen=True)
class Forest:
    """A tree for each group: ranges of the features, splits of each level, classes of the leaves."""

    by: list[str]
    features: list[str]
    bins: int
    ranges: DataFrame
    levels: list[DataFrame]
    leaves: DataFrame

    def binned(self, rows: DataFrame) -> DataFrame:
        """``_bins``: the bin of each feature, -1 where the value is missing."""
        place = lambda f: F.coalesce(F.least(F.lit(self.bins - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(F.col(f) - F.col(f"_lo_{f}"), F.col(f"_hi_{f}") - F.col(f"_lo_{f}")) * self.bins), F.when(F.col(f).isNotNull(), 0)))), F.lit(-1)).cast("int")
        own = rows.join(self.ranges, self.by).withColumn("_bins", F.array(*[place(f) for f in self.features]))
        return own.drop(*[f"_{k}_{f}" for f in self.features for k in ("lo", "hi")])

    def predict(self, binned: DataFrame) -> DataFrame:
        """``binned`` rows with ``predicted``."""
        own = binned.withColumn("_node", F.lit(0).cast("long"))
        for splits in self.levels:
            own = _sent(own, splits, self.by)
        return own.join(self.leaves, [*self.by, "_node"], "left").drop("_node")


def _sent(rows: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    right = F.element_at("_bins", F.col("_feature") + 1) > F.col("_cut")
    moved = F.when(F.col("_cut").isNotNull(), 2 * F.col("_node") + 1 + right.cast("long")).otherwise(F.col("_node"))
    return rows.join(splits, [*by, "_node"], "left").withColumn("_node", moved).drop("_feature", "_cut")


def grow(train: DataFrame, features: list[str], y: str, classes: list[int], by: list[str], depth: int = 3, bins: int = 32, least: int = 5) -> Forest:
    """Trees of at most ``depth`` splits by the Gini impurity; both sides of a split hold ``least`` rows. Among equal splits
    the first feature and the lowest bin win, among equal classes of a leaf the greatest."""
    train = train.where(F.col(y).isNotNull())
    ranges = stored(train.groupBy(*by).agg(*[f(c).alias(f"_{k}_{c}") for c in features for k, f in (("lo", F.min), ("hi", F.max))]))
    forest = Forest(by, features, bins, ranges, [], ranges)
    counts: dict[int, Column] = {c: F.count_if(F.col(y) == c).alias(f"_c{i}") for i, c in enumerate(classes)}
    names = [f"_c{i}" for i in range(len(classes))]
    rows = stored(forest.binned(train).select(*by, y, "_bins").withColumn("_node", F.lit(0).cast("long")))
    levels = []
    for _ in range(depth):
        long = rows.select(*by, y, "_node", F.posexplode("_bins").alias("_feature", "_bin"))
        table = long.groupBy(*by, "_node", "_feature", "_bin").agg(*counts.values())
        node = Window.partitionBy(*by, "_node", "_feature")
        upto = node.orderBy("_bin")
        sides = table.select("*", *[F.sum(c).over(upto).alias(f"_l{c}") for c in names], *[F.sum(c).over(node).alias(f"_t{c}") for c in names])
        left, total = ([F.col(f"_{k}{c}") for c in names] for k in "lt")
        right = [t - v for t, v in zip(total, left)]
        size = lambda part: reduce(lambda a, b: a + b, part)
        rest = lambda part: size(part) - F.coalesce(F.try_divide(size([v * v for v in part]).cast("double"), size(part)), F.lit(0.0))
        gain = rest(total) - rest(left) - rest(right)
        found = sides.where((size(left) >= least) & (size(right) >= least)).withColumn("_gain", gain).where("_gain > 1e-9")
        best = found.groupBy(*by, "_node").agg(F.max_by(F.struct("_feature", F.col("_bin").alias("_cut")), F.struct("_gain", -F.col("_feature"), -F.col("_bin"))).alias("_s"))
        splits = stored(best.select(*by, "_node", "_s.*"))
        levels.append(splits)
        rows = stored(_sent(rows, splits, by))
    class_of = F.greatest(*[F.struct(F.col(n).alias("n"), F.lit(c).alias("c")) for n, c in zip(names, classes)])["c"]
    leaves = rows.groupBy(*by, "_node").agg(*counts.values()).select(*by, "_node", class_of.alias("predicted"))
    return Forest(by, features, bins, ranges, levels, stored(leaves))


def classifier(parts: DataFrame, features: list[str], y: str, classes: list[int], by: list[str]) -> DataFrame:
    """A tree for each group, fitted on its training rows: rows of the validation part, accuracy, and that of the most
    frequent training class. ``parts``: the columns ``by``, role, features and y."""
    train, test = parts.where("role = 'train'"), parts.where("role = 'validation'").where(F.col(y).isNotNull())
    forest = grow(train, features, y, classes, by)
    seen = train.where(F.col(y).isNotNull()).groupBy(*by, y).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max_by(y, F.struct("_n", y)).alias("_usual"))
    judged = forest.predict(forest.binned(test)).join(seen, by)
    right = lambda c: F.avg((F.col(c) == F.col(y)).cast("double"))
    return judged.groupBy(*by).agg(F.count("*").alias("n"), right("predicted").alias("accuracy"), right("_usual").alias("baseline"))


def importance(parts: DataFrame, features: list[str], y: str, classes: list[int], by: list[str], key: str, seed: int = 7) -> DataFrame:
    """Drop in validation accuracy over all groups when one feature's values are dealt anew among a group's validation
    rows, by the order of a hash of (seed, key): feature, drop, accuracy. The same at every partitioning."""
    forest = grow(parts.where("role = 'train'"), features, y, classes, by)
    test = stored(forest.binned(parts.where("role = 'validation'").where(F.col(y).isNotNull())).select(*by, key, y, "_bins"))
    group = Window.partitionBy(*by)
    # a fold's validation rows are one group
    place = test.withColumn("_at", F.row_number().over(group.orderBy(F.xxhash64(F.lit("place"), key), key)))
    dealt = test.select(*by, F.col("_bins").alias("_other"), F.row_number().over(group.orderBy(F.xxhash64(F.lit(seed), key), key)).alias("_at"))
    both = place.join(dealt, [*by, "_at"])
    with_other = lambda i: F.concat(F.slice("_bins", 1, i), F.slice("_other", i + 1, 1), F.slice("_bins", i + 2, len(features)))
    variants = F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.col("_bins")), *[F.struct(F.lit(f).alias("feature"), with_other(i).alias("_bins")) for i, f in enumerate(features)])
    many = both.select(*by, y, F.inline(variants))
    scores = forest.predict(many).groupBy("feature").agg(F.avg((F.col("predicted") == F.col(y)).cast("double")).alias("accuracy"))
    whole = scores.where("feature is null").select(F.col("accuracy").alias("_whole"))  # one row
    return scores.where("feature is not null").crossJoin(F.broadcast(whole)).select("feature", (F.col("_whole") - F.col("accuracy")).alias("drop"), "accuracy")
