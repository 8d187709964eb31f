"""Checks of bars, feeds and datasets. Each returns violations or counts; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, base, reads
from tidemark.operators.selection import elements
from tidemark.operators.windows import series
from tidemark.sources.scratch import stored


@reads(1)
def neighbours(bars: DataFrame, *columns: str | Column) -> DataFrame:
    """Each row's time, the time of the row before, and some columns."""
    return bars.select(*base(bars), *columns, F.lag("ts").over(series()).alias("before"))


def gaps(bars: DataFrame | Blocks, seconds: int, tolerance: float = 2.0) -> DataFrame:
    """Neighbouring bars further apart than tolerance x the expected distance, with the bars missing between."""
    delta = F.unix_timestamp("ts") - F.unix_timestamp("before")
    own = neighbours(bars)
    weekend = F.exists(F.sequence(F.to_date("before"), F.to_date("ts")), lambda d: F.weekday(d) >= 5)
    return own.where(delta > tolerance * seconds).select("symbol", F.col("before").alias("gap_start"), F.col("ts").alias("gap_end"), (F.round(delta / seconds).cast("long") - 1).alias("missing"), F.when(weekend, "weekend").otherwise("suspicious").alias("kind"))


def missing_bars(bars: DataFrame | Blocks, seconds: int) -> DataFrame:
    """Every expected time without a bar between the first and the last; only rows at a gap are expanded."""
    own = neighbours(bars).where(F.unix_timestamp("ts") - F.unix_timestamp("before") > seconds)
    step = F.expr(f"interval {seconds} seconds")
    return own.select("symbol", F.explode(F.sequence(F.col("before") + step, F.col("ts") - step, step)).alias("ts"))


def duplicates(rows: DataFrame, tie: str) -> DataFrame:
    """Second and later rows of one (symbol, ts), with the first one's ``tie`` value."""
    w = Window.partitionBy("symbol", "ts").orderBy(tie)
    return rows.select("symbol", "ts", F.col(tie).alias("row"), F.first(tie).over(w).alias("first_row"), F.row_number().over(w).alias("nth")).where("nth > 1")


def z_outliers(bars: DataFrame, x: str, limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` population deviations from the mean of their series."""
    stats = bars.groupBy("symbol").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    z = (F.col(x) - F.col("mean")) / F.col("sd")
    return bars.join(stats, "symbol").where((F.col("sd") > 0) & (F.abs(z) > limit)).select("symbol", "ts", x, z.alias("z"))


def iqr_outliers(bars: DataFrame, x: str, factor: float = 1.5) -> DataFrame:
    """Values outside the quartile fences; quartiles are the elements n//4 and 3n//4 of the ascending values."""
    q = elements(bars, x, {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)})
    span = factor * (F.col("q3") - F.col("q1"))
    return bars.join(q, "symbol").where((F.col(x) < F.col("q1") - span) | (F.col(x) > F.col("q3") + span)).select("symbol", "ts", x)


def valid_bar() -> Column:
    """Prices positive, high and low enclosing open and close, volume not negative."""
    return F.coalesce((F.col("low") > 0) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0), F.lit(False))


def validation_report(bars: DataFrame | Blocks, seconds: int) -> DataFrame:
    """One row per symbol from one sorted scan: rows, span, duplicates, gaps, missing bars, invalid bars, coverage."""
    own = neighbours(bars, "volume", valid_bar().alias("_ok")).withColumn("_d", F.unix_timestamp("ts") - F.unix_timestamp("before"))
    gap = F.col("_d") > seconds
    got = own.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("_d") == 0).alias("duplicates"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.round(F.col("_d") / seconds).cast("long") - 1)), F.lit(0)).alias("missing"), F.count_if(~F.col("_ok")).alias("invalid"), F.avg("volume").alias("mean_volume"), F.countDistinct(F.to_date("ts")).alias("days"))
    return got.withColumn("coverage", F.col("n") / (F.col("n") + F.col("missing")))


def upper_median_interval(bars: DataFrame | Blocks) -> DataFrame:
    """Element n//2 of the ascending distances between neighbours, in seconds."""
    d = neighbours(bars).select("symbol", (F.unix_timestamp("ts") - F.unix_timestamp("before")).alias("d")).where("d is not null")
    return elements(d, "d", {"seconds": F.floor(F.col("n") / 2)}).select("symbol", F.col("seconds").cast("long").alias("seconds"))


#: Distinct row hashes that one leaf of a digest's tree holds, about.
LEAF = 1024


def dataset_digest(rows: DataFrame, columns: list[str], by: str, leaf: int = LEAF) -> DataFrame:
    """A digest that does not depend on row order or partitioning: the root of a hash tree over the hashes of rows.

    A leaf holds the hashes with one prefix, whose length follows the number of rows, so that no list grows with the
    dataset; repeated rows count in one entry. Nodes hash their at most sixteen children in order, one digit shorter
    in each step up.
    """
    one = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    hashes = rows.select(by, one.alias("_h")).groupBy(by, "_h").agg(F.count("*").alias("_c"))
    sizes = stored(rows.groupBy(by).agg(F.count("*").alias("n")))
    depth = sum((F.when(F.col("n") > leaf * 16**k, 1).otherwise(0) for k in range(12)), F.lit(0))
    placed = hashes.join(sizes.select(F.col(by).alias("_by"), depth.alias("_length")), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_p", F.expr("substring(_h, 1, _length)"))
    entry = F.concat_ws(":", "_h", F.col("_c").cast("string"))
    nodes = placed.groupBy(by, "_length", "_p").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(entry))), 256).alias("_d"))
    deepest = sizes.agg(F.max(depth)).first()[0] or 0
    for length in range(deepest, 0, -1):
        child = F.struct(F.substring("_p", length, 1).alias("at"), "_d")
        text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["at"], c["_d"])))
        up = nodes.where(F.col("_length") == length).groupBy(by, F.substring("_p", 1, length - 1).alias("_p")).agg(F.sha2(text, 256).alias("_d"))
        nodes = nodes.where(F.col("_length") < length).unionByName(up.withColumn("_length", F.lit(length - 1)))
    root = nodes.select(F.col(by).alias("_by"), F.col("_d").alias("digest"))
    return sizes.join(root, F.col(by).eqNullSafe(F.col("_by"))).select(by, "digest", "n")


def audit_faults(log: DataFrame, block: int = 65536) -> DataFrame:
    """Entries (rowid, entry_hash, previous_entry, payload) whose number, link or own hash is wrong.

    Neighbours are compared inside blocks of row numbers; the first entry of a block is compared with the last one of the
    block before it, from a table with one row a block. A log that has ``part`` is one chain for each part.
    """
    by = ["part"] if "part" in log.columns else []
    own = log.withColumn("_block", F.floor(F.col("rowid") / block))
    w = Window.partitionBy(*by, "_block").orderBy("rowid")
    ends = own.groupBy(*by, "_block").agg(F.max_by(F.struct("rowid", "entry_hash"), "rowid").alias("_end"))
    chain = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    before = ends.select(*by, "_block", F.lag("_end").over(chain).alias("_before"))
    own = own.withColumn("_own", F.lag(F.struct("rowid", "entry_hash")).over(w)).join(before, [*by, "_block"]).withColumn("_prev", F.coalesce("_own", "_before"))
    id_, hash_ = F.col("_prev")["rowid"], F.col("_prev")["entry_hash"]
    kind = F.when(id_.isNotNull() & (F.col("rowid") != id_ + 1), "sequence").when(hash_.isNotNull() & ~F.col("previous_entry").eqNullSafe(hash_), "link").when(F.sha2("payload", 256) != F.col("entry_hash"), "hash")
    return own.withColumn("fault", kind).where(F.col("fault").isNotNull()).select(*log.columns, "fault")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are null or NaN per column, long form, from one row of counts."""
    types = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
    row = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns], F.count("*").alias("_n"))
    return row.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns]))).select("column", "bad", F.col("_n").alias("n"))
