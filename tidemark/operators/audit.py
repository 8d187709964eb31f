"""Audits of feeds, events, partitions, datasets and stored results. Each reports; nothing is repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import overlap_counts
from tidemark.operators.windows import series

#: Words in a source's name that rule it out as evidence.
BLOCKED = ("synthetic", "demo", "mock", "fixture")


def _finite(c: str) -> Column:
    return F.coalesce(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False))


def minute_feed(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Counts per symbol over minute rows (ts, open, high, low, close, tick_volume, real_volume, spread): repeated,
    out-of-range and missing times, invalid prices, volumes and spreads, the greatest distance between distinct
    neighbouring times and how many pass 60 seconds."""
    prices = ["open", "high", "low", "close"]
    sound = reduce(lambda a, b: a & b, [_finite(c) & (F.coalesce(F.col(c), F.lit(0.0)) > 0) for c in prices])
    sound = sound & F.coalesce((F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low")), F.lit(False))
    off = lambda c: ~(_finite(c) & (F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) >= 0))
    within = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    counts = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("missing_ts"), F.count_if(~within).alias("out_of_range"), F.count_if(~sound).alias("invalid_prices"),
        (F.count_if(off("tick_volume")) + F.count_if(off("real_volume"))).alias("invalid_volumes"), F.count_if(off("spread")).alias("invalid_spreads"),
    )
    times = rows.where(F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(F.count("*").alias("_c"))
    times = times.select("symbol", "_c", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(series()))).alias("_d"))
    spans = times.groupBy("symbol").agg(F.count("*").alias("times"), F.sum(F.col("_c") - 1).alias("duplicates"), F.coalesce(F.max("_d"), F.lit(0)).alias("max_gap"), F.count_if(F.col("_d") > 60).alias("gaps"))
    return counts.join(spans, "symbol", "left")


def gap_kind(start: Column, end: Column) -> Column:
    """Whether a gap touches a Saturday or Sunday; no proof that the market was closed."""
    weekend = F.exists(F.sequence(F.to_date(start), F.to_date(end)), lambda d: F.weekday(d) >= 5)
    return F.when(weekend, "weekend_overlap_candidate").otherwise("non_weekend_suspicious")


def self_audit(events: DataFrame, conditions: DataFrame, least: int = 5, most: int = 10, corrected: bool = False) -> DataFrame:
    """How many faults of each kind a study has, in long form: check, n. ``events``: event_id, symbol, ts, event_type,
    direction, outcome_ts, realized_end and ``seq``, their place in the file; ``conditions``: name, n, p (a small table).

    Missing outcomes and realised ends, repeated events, disorder, outcomes dated before their event, overlapping
    labels, small samples, too many conditions, several without correction, and extreme probabilities of few events.
    """
    twice = events.groupBy("symbol", "ts", "event_type", "direction").agg((F.count("*") - 1).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    order = Window.partitionBy("symbol").orderBy("seq")
    disorder = events.select((F.col("ts") < F.lag("ts").over(order)).alias("_d")).agg(F.count_if("_d").alias("n"))
    plain = events.agg(F.count_if(F.col("event_id").isNull() | F.col("outcome_ts").isNull()).alias("missing_provenance"), F.count_if(F.col("realized_end").isNull()).alias("missing_realized_end"), F.count_if(F.col("outcome_ts") < F.col("ts")).alias("future_leakage"))
    overlaps = overlap_counts(events.select("symbol", F.col("ts").alias("start"), F.col("realized_end").alias("stop")).where("stop is not null")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))
    k = F.count("*")
    found = conditions.agg(
        F.count_if(F.col("n") < least).alias("insufficient_sample_size"), F.when(k > most, 1).otherwise(0).cast("long").alias("condition_explosion"), F.when((k > 1) & ~F.lit(corrected), 1).otherwise(0).cast("long").alias("multiple_testing"),
        F.count_if((F.col("n") > 0) & (F.abs(F.col("p") - 0.5) > 0.45) & (F.col("n") < 10)).alias("invalid_probability"),
    )
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in df.columns])))
    one = lambda df, name: df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [long(plain), long(found), one(twice, "duplicate_events"), one(disorder, "timestamp_violations"), one(overlaps, "overlapping_labels")])


def audit_status(faults: DataFrame) -> DataFrame:
    """PASS without faults, FAIL where an outcome precedes its event, else WARNING."""
    leak = F.sum(F.when(F.col("check") == "future_leakage", F.col("n")).otherwise(0))
    return faults.agg(F.sum("n").alias("faults"), F.when(F.sum("n") == 0, "PASS").when(leak > 0, "FAIL").otherwise("WARNING").alias("status"))


def label_leaks(parts: DataFrame, by: str = "fold") -> DataFrame:
    """Folds whose training labels reach into validation or whose validation labels reach into the test part, and
    labels without an end. ``parts``: fold, role (train, validation, test), ts, realized_end. A fold that lacks a part
    has no leak."""
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    own = parts.groupBy(by).agg(
        F.max(of("train", "realized_end")).alias("_t"), F.min(of("validation", "ts")).alias("_v0"), F.max(of("validation", "realized_end")).alias("_v"), F.min(of("test", "ts")).alias("_s0"),
        F.count_if(F.col("role").isin("train", "validation") & F.col("realized_end").isNull()).alias("without_end"), F.count_if(F.col("role") == "train").alias("_n"),
    )
    whole = (F.col("_n") > 0) & F.col("_v0").isNotNull() & F.col("_s0").isNotNull()
    leak = lambda c: F.coalesce(whole & c, F.lit(False))
    return own.select(by, leak(F.col("_t") >= F.col("_v0")).alias("into_validation"), leak(F.col("_v") >= F.col("_s0")).alias("into_test"), F.when(whole, F.col("without_end")).otherwise(0).alias("without_end"))


def production_gate(events: DataFrame, minimum: int = 100) -> DataFrame:
    """Per source: events, faults of each kind, and whether it may serve as evidence. ``events``: source, event_id, ts,
    seq, outcome_event_id, outcome_ts. Blocked names, too few events, events without an outcome or with one of another
    event or time, and disorder rule a source out."""
    name = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    blocked = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in BLOCKED]) | (name == "")
    own = events.withColumn("_back", F.col("ts") < F.lag("ts").over(Window.partitionBy("source").orderBy("seq")))
    missing = F.col("outcome_event_id").isNull()
    got = own.groupBy("source").agg(F.count("*").alias("events"), F.count_if("_back").alias("disorder"), F.count_if(missing).alias("missing_outcome"), F.count_if(F.col("outcome_event_id") != F.col("event_id")).alias("identity"), F.count_if(~missing & ~F.col("outcome_ts").eqNullSafe(F.col("ts"))).alias("time"))
    faults = F.col("disorder") + F.col("missing_outcome") + F.col("identity") + F.col("time")
    return got.withColumn("blocked", blocked).withColumn("passed", ~F.col("blocked") & (F.col("events") >= minimum) & (faults == 0))


def dataset_faults(features: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs per feature and in the label, and rows that only one side has: check, n. Both sides: symbol, ts."""
    both = features.select("symbol", "ts", *columns, F.lit(True).alias("_f")).join(labels.select("symbol", "ts", "label", F.lit(True).alias("_l")), ["symbol", "ts"], "full_outer")
    inside = F.col("_f").isNotNull() & F.col("_l").isNotNull()
    bad = lambda c: inside & (F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)))
    row = both.agg(*[F.count_if(bad(c)).alias(c) for c in [*columns, "label"]], F.count_if(F.col("_l").isNull()).alias("without_label"), F.count_if(F.col("_f").isNull()).alias("without_features"), F.count_if(inside).alias("samples"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in row.columns])))


def session_boundaries(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """Per day two feeds side by side: rows, distinct times, first and last time, high and low; null where one lacks the
    day."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias(f"rows_{s}"), F.countDistinct("ts").alias(f"times_{s}"), F.min("ts").alias(f"first_{s}"), F.max("ts").alias(f"last_{s}"), F.max("high").alias(f"high_{s}"), F.min("low").alias(f"low_{s}"))

    return side(a, "a").join(side(b, "b"), [key, "day"], "full_outer")


def continuity(context: DataFrame, research: DataFrame, columns: list[str]) -> DataFrame:
    """Days that two stores share, per column: how many, how many differ, mean and greatest relative difference."""
    both = context.select("day", *[F.col(c).alias(f"_{c}") for c in columns]).join(research.select("day", *columns), "day")
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("a"), F.col(c).alias("b")) for c in columns]
    long = both.select("day", F.inline(F.array(*parts))).withColumn("gap", F.try_divide(F.abs(F.col("a") - F.col("b")), F.greatest(F.abs("b"), F.lit(1e-12))))
    return long.groupBy("column").agg(F.count("gap").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def recheck(stored: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str], within: float = 1e-9) -> DataFrame:
    """Rows of a stored result that differ from the recomputed one, or that only one of them has."""
    both = stored.select(*key, *[F.col(c).alias(f"stored_{c}") for c in columns], F.lit(True).alias("_s")).join(recomputed.select(*key, *columns, F.lit(True).alias("_r")), key, "full_outer")
    apart = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(f"stored_{c}") - F.col(c)) > within, F.col(f"stored_{c}").isNull() != F.col(c).isNull()) for c in columns])
    fault = F.when(F.col("_s").isNull(), "missing").when(F.col("_r").isNull(), "unknown").when(apart, "differs")
    return both.withColumn("fault", fault).where("fault is not null").select(*key, "fault")
