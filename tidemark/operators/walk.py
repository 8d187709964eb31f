"""Walk-forward studies: folds over events, fitted conditions, model against baseline, discovery, calibration, gates.

Fold tables are small. Rows join the folds they belong to by the row numbers that a fold covers, and every fold is one
group of the same aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import totals_before
from tidemark.operators.stats import wilson


def numbered(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), unit: str = "month") -> DataFrame:
    """Events with ``idx``, their place in time over all symbols: counted inside clock buckets, then summed up."""
    own = events.withColumn("_bucket", F.date_trunc(unit, order[0]))
    sizes = own.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = own.withColumn("_k", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_bucket").withColumn("idx", F.col("_before") + F.col("_k")).drop("_bucket", "_before", "_k")


def fold_table(events: DataFrame, train: int, validation: int, test: int, step: int) -> DataFrame:
    """Expanding folds over numbered events: fold, v0 and s0 (first validation and test row), s1 (end of the test part),
    and the times of the first two. Every fold has all its validation and test rows."""
    n = events.agg(F.count("*").alias("n")).first()["n"]
    table = events.sparkSession.range(max(0, (n - train - validation - test) // step + 1)).select(F.col("id").cast("int").alias("fold"), (F.lit(train) + F.col("id") * step).alias("v0"))
    table = table.withColumn("s0", F.col("v0") + validation).withColumn("s1", F.col("s0") + test)
    at = events.select("idx", "ts")
    return table.join(at.select(F.col("idx").alias("v0"), F.col("ts").alias("v_ts")), "v0").join(at.select(F.col("idx").alias("s0"), F.col("ts").alias("s_ts")), "s0")


def held_out_rows(events: DataFrame, folds: DataFrame, train: int, validation: int, test: int, step: int, purge_days: int = 0, embargo_days: int = 0) -> DataFrame:
    """Validation and test rows of each fold: validation is purged before the test part, which starts ``embargo_days``
    late. A row's folds follow from its number, so rows meet folds by an equi-join."""
    i = F.col("idx")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((i - train - validation - test + 1) / step))
    until = F.floor((i - train) / step)
    own = events.where((i >= train) & (first <= until)).withColumn("fold", F.explode(F.sequence(first.cast("int"), until.cast("int")))).join(folds, "fold")
    purge, embargo = F.expr(f"interval {purge_days} days"), F.expr(f"interval {embargo_days} days")
    role = F.when((i < F.col("s0")) & (F.col("ts") < F.col("s_ts") - purge), "validation").when((i >= F.col("s0")) & (i < F.col("s1")) & (F.col("ts") >= F.col("s_ts") + embargo), "test")
    return own.withColumn("role", role).where("role is not null").select(*events.columns, "fold", "role")


def validate_condition(events: DataFrame, matched: Column, outcome: str, sizes: tuple[int, int, int, int] = (100, 50, 50, 50), purge_days: int = 0, embargo_days: int = 0, least: int = 20, tolerance: float = 0.15, z: float = 1.959963984540054) -> DataFrame:
    """Per expanding fold (``sizes``: train, validation, test, step), over matched events with a finite outcome: counts,
    shares above zero and means of the three parts, the Wilson interval of the test share, and whether the fold passes:
    enough test events and shares no further apart than ``tolerance``. Parts without matches count as 0.

    ``events``: idx, ts. Training counts come from daily sums, so an event is not copied into every later fold.
    """
    x = F.col(outcome).cast("double")
    fits = matched & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    folds = fold_table(events, *sizes)
    sums = {"n": F.lit(1).cast("long"), "up": (x > 0).cast("long"), "total": x}
    trained = totals_before(events.where(fits), "ts", folds.select("fold", (F.col("v_ts") - F.expr(f"interval {purge_days} days")).alias("cutoff")), [], sums)
    rows = held_out_rows(events, folds, *sizes, purge_days, embargo_days).where(fits)
    of = lambda role, f, c: f(F.when(F.col("role") == role, c))
    aside = rows.groupBy("fold").agg(*[of(r, F.sum, c).alias(f"{n}_{r}") for r in ("validation", "test") for n, c in sums.items()])
    own = folds.select("fold").join(trained.withColumnsRenamed({n: f"{n}_train" for n in sums}), "fold", "left").join(aside, "fold", "left").na.fill(0)
    roles = ("train", "validation", "test")
    share = {r: F.coalesce(F.try_divide(f"up_{r}", f"n_{r}"), F.lit(0.0)) for r in roles}
    mean = {r: F.coalesce(F.try_divide(f"total_{r}", f"n_{r}"), F.lit(0.0)) for r in roles}
    lo, hi = wilson(F.col("up_test"), F.col("n_test"), z)
    passed = (F.col("n_test") >= least) & (F.greatest(*share.values()) - F.least(*share.values()) <= tolerance)
    return own.select("fold", *[F.col(f"n_{r}") for r in roles], *[share[r].alias(f"p_{r}") for r in roles], *[mean[r].alias(f"mean_{r}") for r in roles], lo.alias("ci_lo"), hi.alias("ci_hi"), passed.alias("passed"))


def verdict(folds: DataFrame) -> DataFrame:
    """VALIDATED if every fold passes, INCONCLUSIVE if one does not, INSUFFICIENT_DATA without folds."""
    return folds.agg(F.count("*").alias("folds"), F.count_if("passed").alias("passed")).withColumn("status", F.when(F.col("folds") == 0, "INSUFFICIENT_DATA").when(F.col("passed") == F.col("folds"), "VALIDATED").otherwise("INCONCLUSIVE"))


def rolling_folds(rows: DataFrame, train: int, validation: int, step: int, by: str = "symbol") -> DataFrame:
    """Each (row, fold) with its role in folds of fixed length that move ``step`` rows at a time; a fold needs all its
    rows. ``rows``: by, idx. A row is in at most (train + validation) / step folds, exploded from its number."""
    sized = rows.join(rows.groupBy(by).agg(F.count("*").alias("_n")), by)
    span = train + validation
    last = F.floor((F.col("_n") - span) / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - span + 1) / step))
    until = F.least(last, F.floor(F.col("idx") / step))
    own = sized.where((F.col("_n") >= span) & (first <= until)).withColumn("fold", F.explode(F.sequence(first, until)))
    return own.withColumn("role", F.when(F.col("idx") - F.col("fold") * step < train, "train").otherwise("validation")).drop("_n")


def binned_model(parts: DataFrame, x: str, y: str, bins: int, keys: list[str]) -> DataFrame:
    """Validation rows with the class that is most frequent in their bin of ``x`` among the fold's training rows (ties
    to the greater class), the training share of each class there, and the fold's majority class as the baseline.

    Bins have equal width between the training extremes; rows of an empty bin take the shares of the whole fold.
    Classes are 1, 0 and -1.
    """
    train, test = parts.where("role = 'train'"), parts.where("role = 'validation'")
    ends = train.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)))).cast("int")
    count = lambda k: F.count_if(F.col(y) == k).cast("double")
    share = {k: (count(k) / F.count("*")).alias(f"p_{n}") for k, n in ((1, "up"), (0, "flat"), (-1, "down"))}
    table = train.join(ends, keys).groupBy(*keys, place.alias("_bin")).agg(*share.values())
    whole = train.groupBy(*keys).agg(*[c.alias(f"_{n}") for c, n in zip(share.values(), ("up", "flat", "down"))])
    got = test.join(ends, keys).withColumn("_bin", place).join(table, [*keys, "_bin"], "left").join(whole, keys)
    got = got.withColumns({f"p_{n}": F.coalesce(f"p_{n}", f"_{n}") for n in ("up", "flat", "down")})
    best = lambda u, f, d: F.when((u >= f) & (u >= d), 1).when(f >= d, 0).otherwise(-1)
    out = got.withColumns({"predicted": best(F.col("p_up"), F.col("p_flat"), F.col("p_down")), "baseline": best(F.col("_up"), F.col("_flat"), F.col("_down"))})
    return out.drop("_lo", "_hi", "_bin", "_up", "_flat", "_down", "role")


def brier(y: str) -> Column:
    """Three-class Brier score of a row."""
    return sum(((F.col(f"p_{n}") - F.when(F.col(y) == k, 1.0).otherwise(0.0)) ** 2 for k, n in ((1, "up"), (0, "flat"), (-1, "down"))), F.lit(0.0))


def experiment(scored: DataFrame, y: str, cost: Column, by: list[str]) -> DataFrame:
    """Model against baseline: accuracies, Brier score, precision and recall of both directions, accuracy net of cost
    (a directional prediction counts only if the move ``ret`` passes ``cost``), and the discordant pairs."""
    hit, base = F.col("predicted") == F.col(y), F.col("baseline") == F.col(y)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    both = lambda k: (F.col("predicted") == k) & (F.col(y) == k)
    net = hit & ((F.col("predicted") == 0) | (F.abs("ret") > cost))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(base.cast("double")).alias("baseline_accuracy"), F.avg(brier(y)).alias("brier"),
        ratio(both(1), F.col("predicted") == 1).alias("precision_up"), ratio(both(-1), F.col("predicted") == -1).alias("precision_down"), ratio(both(1), F.col(y) == 1).alias("recall_up"), ratio(both(-1), F.col(y) == -1).alias("recall_down"),
        F.avg(net.cast("double")).alias("net_accuracy"), F.count_if(hit & ~base).alias("wins"), F.count_if(base & ~hit).alias("losses"),
    )


def candidates(fields: dict[str, list], medians: dict[str, float], signed: tuple[str, ...] = ()) -> dict[str, Column]:
    """Named predicates: equality with each value of a category, above or not above a training median, and for some
    numbers above or below zero."""
    out = {f"{f}={v}": F.col(f) == v for f, values in fields.items() for v in values}
    for f, m in medians.items():
        out |= {f"{f}>median": F.col(f) > m, f"{f}<=median": F.col(f) <= m}
        if f in signed:
            out |= {f"{f}>0": F.col(f) > 0, f"{f}<0": F.col(f) < 0}
    return out


def _jeffreys(hits: Column, n: Column) -> Column:
    return (0.5 + hits) / (1.0 + n)


def candidate_scores(parts: DataFrame, predicates: dict[str, Column], label: str, least: int) -> DataFrame:
    """Per fold and candidate with at least ``least`` inner training and validation rows: by how much its Jeffreys
    probability beats the fold's on the Brier score of the inner validation rows it selects. ``parts``: fold, role
    (inner_train, inner_validation). Events are exploded over the candidates they meet: one aggregate for all."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in predicates.items()]))
    y = F.col(label).cast("double")
    whole = parts.where("role = 'inner_train'").groupBy("fold").agg(_jeffreys(F.sum(y), F.count("*")).alias("_base"))
    tr, va = F.col("role") == "inner_train", F.col("role") == "inner_validation"
    found = parts.select("fold", "role", y.alias("y"), F.explode(names).alias("candidate")).groupBy("fold", "candidate").agg(
        F.count_if(tr).alias("n_train"), F.sum(F.when(tr, F.col("y")).otherwise(0.0)).alias("_h"), F.count_if(va).alias("n_validation"), F.sum(F.when(va, F.col("y")).otherwise(0.0)).alias("_v")
    )
    found = found.where((F.col("n_train") >= least) & (F.col("n_validation") >= least)).join(F.broadcast(whole), "fold")
    model, n, hits = _jeffreys(F.col("_h"), F.col("n_train")), F.col("n_validation"), F.col("_v")
    loss = lambda p: (hits * (1 - p) ** 2 + (n - hits) * p**2) / n
    return found.select("fold", "candidate", "n_train", "n_validation", (loss(F.col("_base")) - loss(model)).alias("improvement"))


def best_candidate(scores: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best candidates of each fold by improvement (to twelve decimals), validation rows and name."""
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("improvement", 12)), F.desc("n_validation"), "candidate")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def interactions(scores: DataFrame, predicates: dict[str, Column], k: int) -> dict[str, Column]:
    """Conjunctions of the candidates that are among the ``k`` best of a fold (a few names, gathered)."""
    seeds = sorted(r["candidate"] for r in best_candidate(scores, k).select("candidate").distinct().collect())
    return {f"({a}) AND ({b})": predicates[a] & predicates[b] for i, a in enumerate(seeds) for b in seeds[i + 1 :]}


def shuffled_labels(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``df`` with its labels permuted among its rows: rows in the order of their key take the labels in the order of a
    hash of (seed, key). Places are counted inside ranges of the hash, so no task sorts the whole table."""
    parts = 64

    def placed(order: Column, name: str, *columns) -> DataFrame:
        own = df.select(*columns, order.alias("_o")).withColumn("_p", F.pmod(F.shiftright("_o", 57), F.lit(parts)))
        sizes = own.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
        return own.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_o", key))).join(F.broadcast(sizes), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_o", "_k", "_before")

    a = placed(F.xxhash64(F.lit("place"), key), "_at", *df.columns)
    b = placed(F.xxhash64(F.lit(seed), key), "_at", key, F.col(label).alias("_label"))
    return a.join(b.select("_at", "_label"), "_at").select(*[c for c in df.columns if c != label], label, F.col("_label").alias("shuffled"))


def shuffle_control(df: DataFrame, label: str) -> DataFrame:
    """Rates before and after, whether the labels are the same multiset, and how many rows kept theirs."""
    x, y = F.col(label).cast("double"), F.col("shuffled").cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(x).alias("rate"), F.avg(y).alias("shuffled_rate"), (F.sum(x) == F.sum(y)).alias("preserved"), F.count_if(F.col(label) == F.col("shuffled")).alias("same_place"))


def inject_leak(parts: DataFrame, key: str) -> DataFrame:
    """A control that an audit must reject: the first validation row of each group's first fold becomes a training row of
    it as well. ``parts``: symbol, fold, role, ``key``."""
    folds = parts.groupBy("symbol").agg(F.min("fold").alias("fold"))
    first = parts.where("role = 'validation'").join(folds, ["symbol", "fold"]).groupBy("symbol", "fold").agg(F.min(key).alias(key))
    leaked = parts.where("role = 'validation'").join(first, ["symbol", "fold", key]).withColumn("role", F.lit("train")).select(*parts.columns)
    return parts.unionByName(leaked)


def leaks(parts: DataFrame, key: str, at: str) -> DataFrame:
    """Audit of fold membership: keys that are both trained on and judged in one fold, and training rows that are not
    earlier than the fold's first validation row. Empty for a sound table."""
    both = parts.where("role in ('train', 'validation')").groupBy("symbol", "fold", key).agg(F.countDistinct("role").alias("_r")).where("_r = 2").select("symbol", "fold", F.col(key).cast("string").alias("key"), F.lit("in both parts").alias("fault"))
    begins = parts.where("role = 'validation'").groupBy("symbol", "fold").agg(F.min(at).alias("_begin"))
    late = parts.where("role = 'train'").join(begins, ["symbol", "fold"]).where(F.col(at) >= F.col("_begin")).select("symbol", "fold", F.col(key).cast("string").alias("key"), F.lit("not earlier").alias("fault"))
    return both.unionByName(late)


def fold_gate(folds: DataFrame, seed: int = 7, replicates: int = 2000, least_rate: float = 0.7, alpha: float = 0.05, p_limit: float = 0.01) -> DataFrame:
    """Gate over per-fold improvements (fold, baseline, model): positive share, exact sign test, one-sided sign-flip
    p-value and the bootstrap interval of the mean, and whether all pass. A fold table is small: one group."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows["baseline"] - rows["model"]).to_numpy(float)
        n, up, down = len(d), int((d > 0).sum()), int((d < 0).sum())
        k, m = min(up, down), up + down
        sign = 1.0 if m == 0 else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
        rng = np.random.default_rng(seed)
        if n <= 16:
            masks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
            flips = ((2 * masks - 1) * d).mean(1)
            p = float((flips >= d.mean() - 1e-15).mean())
        else:
            flips = (rng.choice([-1.0, 1.0], (replicates * 10, n)) * d).mean(1)
            p = float(((flips >= d.mean() - 1e-15).sum() + 1) / (len(flips) + 1))
        means = np.sort(d[rng.integers(0, n, (replicates, n))].mean(1))
        lo, hi = means[int(0.025 * (replicates - 1))], means[int(0.975 * (replicates - 1))]
        ok = d.mean() > 0 and lo > 0 and p < p_limit and sign < alpha and up / n >= least_rate
        return pd.DataFrame([(n, up, down, up / n, float(d.mean()), sign, p, float(lo), float(hi), bool(ok))], columns=["folds", "positive", "negative", "positive_rate", "mean", "sign_p", "flip_p", "ci_lo", "ci_hi", "passed"])

    return folds.select("baseline", "model").groupBy().applyInPandas(judge, "folds long, positive long, negative long, positive_rate double, mean double, sign_p double, flip_p double, ci_lo double, ci_hi double, passed boolean")



def strategies_by_fold(rows: DataFrame, signals: dict[str, Column], ret: str, cost: float) -> DataFrame:
    """Named signals (1, 0, -1) side by side per fold: rows, trades, total return after cost and share of trades that
    earn more than it."""
    long = rows.select("fold", F.col(ret).alias("_r"), F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("_s")) for n, c in signals.items()])))
    traded, gain = F.col("_s") != 0, F.col("_s") * F.col("_r")
    return long.groupBy("strategy", "fold").agg(F.count("*").alias("n"), F.count_if(traded).alias("trades"), F.sum(gain - F.when(traded, cost).otherwise(0.0)).alias("total"), F.coalesce(F.avg(F.when(traded, (gain > cost).cast("double"))), F.lit(0.0)).alias("win_rate"))
