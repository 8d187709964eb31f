"""As-of, interval and overlap joins over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import corr


def as_of(left: DataFrame, right: DataFrame, columns: list[str], at: str = "ts", key: str = "symbol", forward: bool = False, strict: bool = False, width: int | None = None) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` at or before its ``at`` (``forward``: the first at or after).

    ``strict`` leaves out rows of ``right`` at the very same time. Both sides go through one sort and a running frame, so
    the work is linear in their rows. With ``width`` (seconds) the frames run inside clock buckets of each key, and every
    bucket takes over the last row of the buckets before it from a table with one row a bucket: no task then holds a whole
    series. Without it a key is one task. Columns of ``right`` come as ``asof_ts`` and ``asof_<column>``.
    """
    item = F.struct(F.col("ts").alias("ts"), *columns)
    marks = right.select(key, F.col("ts").alias("_t"), F.lit(1 if strict else 0).alias("_side"), item.alias("_item"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    asks = left.select(key, F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(item_type(right, columns)).alias("_item"), F.struct(*left.columns).alias("_row"))
    order = [F.desc("_t"), F.asc("_side")] if forward else [F.asc("_t"), F.asc("_side")]
    both, keys = marks.unionByName(asks), [key]
    if width is not None:
        both, keys = both.withColumn("_bucket", F.floor(F.unix_timestamp("_t") / width)), [key, "_bucket"]
    seen = F.last("_item", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_hit", seen).where(F.col("_row").isNotNull())
    if width is not None:
        edge = (F.min_by if forward else F.max_by)("_item", F.when(F.col("_item").isNotNull(), F.col("_t")))
        ends = both.groupBy(*keys).agg(edge.alias("_last"))
        earlier = Window.partitionBy(key).orderBy(F.desc("_bucket") if forward else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(key, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
        found = found.join(carried, keys, "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    return found.select("_row.*", F.col("_hit.ts").alias("asof_ts"), *[F.col(f"_hit.{c}").alias(f"asof_{c}") for c in columns])


def item_type(right: DataFrame, columns: list[str]) -> str:
    types = dict(right.dtypes)
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in ["ts", *columns]) + ">"


def range_extremes(spans: DataFrame, bars: DataFrame, width: int = 7 * 86400, key: str = "symbol") -> DataFrame:
    """Highest high and lowest low of the bars in (start, stop] of each span (span_id, key, start, stop).

    Spans and bars meet by time bucket of ``width`` seconds. Buckets that lie wholly inside a span bring one row with
    their own extremes; only the two at its ends are looked at bar by bar.
    """
    bucket = lambda ts: F.floor(F.unix_timestamp(ts) / width)
    cells = bars.groupBy(key, bucket("ts").alias("cell")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    cut = spans.where(F.col("stop").isNotNull()).select("span_id", key, "start", "stop", bucket("start").alias("_a"), bucket("stop").alias("_b"))
    inner = cut.where(F.col("_b") - F.col("_a") > 1).select("span_id", key, F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("cell")).join(cells, [key, "cell"]).select("span_id", "hi", "lo")
    ends = cut.select("span_id", key, "start", "stop", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("cell"))
    edge = ends.join(bars.select(key, "ts", "high", "low", bucket("ts").alias("cell")), [key, "cell"]).where((F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("stop"))).select("span_id", F.col("high").alias("hi"), F.col("low").alias("lo"))
    return inner.unionByName(edge).groupBy("span_id").agg(F.max("hi").alias("highest"), F.min("lo").alias("lowest"))


def overlap_counts(spans: DataFrame, key: str = "symbol") -> DataFrame:
    """Overlapping pairs and most open at once among half-open intervals [start, stop), by a sweep instead of a
    self-join: at equal times ends come before starts."""
    marks = spans.select(key, F.col("start").alias("t"), F.lit(1).alias("step")).unionByName(spans.select(key, F.col("stop").alias("t"), F.lit(-1).alias("step"))).where(F.col("t").isNotNull())
    open_now = F.sum("step").over(Window.partitionBy(key).orderBy("t", "step").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("open", open_now).groupBy(key).agg(F.sum(F.when(F.col("step") == 1, F.col("open") - 1)).alias("pairs"), F.max("open").alias("concurrency"))


def exact_join(price: DataFrame, factors: list[DataFrame], on: str = "day") -> DataFrame:
    """Price and factor series on the days that all of them have; nothing is filled or interpolated."""
    for f in factors:
        price = price.join(f, on)
    return price


def compare_feeds(a: DataFrame, b: DataFrame, column: str = "close") -> DataFrame:
    """Two feeds of the same symbols: rows missing on either side, correlation, mean and greatest difference."""
    both = a.select("symbol", "ts", F.col(column).alias("a")).join(b.select("symbol", "ts", F.col(column).alias("b")), ["symbol", "ts"], "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("a").isNull()).alias("missing_a"), F.count_if(F.col("b").isNull()).alias("missing_b"), corr("a", "b").alias("corr"), F.avg(F.try_divide(gap, F.abs("a"))).alias("mape"), F.max(gap).alias("max_gap")
    )


def quality_grade(compared: DataFrame) -> DataFrame:
    """A grade in words from the correlation and the mean relative difference (as a share) of two feeds."""
    return compared.withColumn("grade", F.when((F.col("corr") > 0.99) & (F.col("mape") < 0.01), "EXCELLENT").when((F.col("corr") > 0.95) & (F.col("mape") < 0.05), "GOOD").otherwise("POOR"))


def alignment_faults(target: DataFrame, factor: DataFrame) -> DataFrame:
    """Positions at which the times of two series (pos, ts) differ or one is missing."""
    return target.select("pos", F.col("ts").alias("target_ts")).join(factor.select("pos", F.col("ts").alias("factor_ts")), "pos", "full_outer").where(~F.col("target_ts").eqNullSafe(F.col("factor_ts")))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, by which end."""
    ids = nodes.select("node").distinct()
    side = lambda c: edges.join(ids.withColumnRenamed("node", c), c, "left_anti").select("parent", "child", F.lit(c).alias("missing"))
    return side("parent").unionByName(side("child"))


def reaction(events: DataFrame, response: DataFrame, lags: int) -> DataFrame:
    """Mean absolute response at 0..``lags`` rows after each event, by row number."""
    spread = events.select("symbol", "idx", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("idx", F.col("idx") + F.col("lag"))
    return spread.join(response.select("symbol", "idx", "value"), ["symbol", "idx"]).groupBy("symbol", "lag").agg(F.count("*").alias("n"), F.avg(F.abs("value")).alias("mean_abs"))
