"""Bars: derived columns, resampling, count chunks, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import row_index


def derived_columns(bars: DataFrame) -> DataFrame:
    """Range, body, wicks, typical price, direction and where the close lies in the range."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    span = F.col("high") - F.col("low")
    return bars.select(
        "*",
        span.alias("range"),
        F.abs(F.col("close") - F.col("open")).alias("body"),
        (F.col("high") - top).alias("upper_wick"),
        (bottom - F.col("low")).alias("lower_wick"),
        ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("typical_price"),
        (F.col("close") > F.col("open")).alias("is_bullish"),
        F.when(span == 0, 0.5).otherwise((F.col("close") - F.col("low")) / span).alias("close_position"),
    )


def ohlc(order: Column, price: str = "price", volume: str = "volume") -> list[Column]:
    """Aggregates of one bar; ``order`` decides which row is first and last."""
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("n_ticks")]


def from_ticks(ticks: DataFrame, unit: str, order: Column) -> DataFrame:
    """Ticks (symbol, ts, price, volume) to bars by clock unit (hour, day, ...): one partial aggregate, one shuffle."""
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts")).agg(*ohlc(order))


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars to longer clock-aligned bars, with the volume-weighted price (typical price where the volume is zero)."""
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n_bars"),
        F.sum(typical * F.col("volume")).alias("_pv"),
    )
    whole = (F.col("high") + F.col("low") + F.col("close")) / 3
    return out.select("symbol", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume", "n_bars", F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(whole).alias("vwap"))


def resample_many(bars: DataFrame, seconds: list[int]) -> DataFrame:
    """Several target timeframes from one scan: the rows are exploded over the targets before one aggregate."""
    wide = bars.withColumn("seconds", F.explode(F.array(*map(F.lit, seconds))))
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("seconds")) * F.col("seconds"))
    return wide.groupBy("symbol", "seconds", bucket.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bucket", "ts")


def count_chunks(bars: DataFrame, k: int) -> DataFrame:
    """Every ``k`` consecutive bars of a symbol form one; the last may hold fewer."""
    chunk = F.floor(F.col("idx") / k)
    return row_index(bars).groupBy("symbol", chunk.alias("chunk")).agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_bars")
    )


def scaled(df: DataFrame, column: str, key: str = "symbol") -> DataFrame:
    """Min-max, z-score and robust scaling per series; a constant series gives 0, 0 and 0."""
    stats = df.groupBy(key).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    x = F.col(column)
    safe = lambda top, bottom: F.when(bottom == 0, 0.0).otherwise(top / bottom)
    return df.join(stats, key).select(
        *df.columns,
        safe(x - F.col("lo"), F.col("hi") - F.col("lo")).alias("min_max"),
        safe(x - F.col("mean"), F.col("sd")).alias("z"),
        safe(x - F.col("q")[1], F.col("q")[2] - F.col("q")[0]).alias("robust"),
    )


def z_bucket(z: Column) -> Column:
    """Magnitude of a z-score in words."""
    size = F.abs(z)
    return F.when(size < 1, "normal").when(size < 2, "elevated").when(size < 3, "high").otherwise("extreme")


def book_metrics(books: DataFrame) -> DataFrame:
    """Best prices, mid, spread and depth of nested order-book levels."""
    price = lambda side: F.transform(side, lambda x: x["price"])
    depth = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["size"])
    bid, ask = F.array_max(price("bids")), F.array_min(price("asks"))
    return books.select("symbol", "ts", bid.alias("best_bid"), ask.alias("best_ask"), ((bid + ask) / 2).alias("mid"), (ask - bid).alias("spread"), ((ask - bid) / ((bid + ask) / 2) * 10000).alias("spread_bps"), depth("bids").alias("bid_depth"), depth("asks").alias("ask_depth"))


def range_query(bars: DataFrame, symbols: list[str], start, end, fields: list[str], limit: int | None = None, descending: bool = False) -> DataFrame:
    """Rows of some symbols between two times, both included; ``limit`` applies per symbol."""
    rows = bars.where(F.col("symbol").isin(symbols) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if limit is not None:
        order = Window.partitionBy("symbol").orderBy(F.desc("ts") if descending else F.asc("ts"))
        rows = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
    return rows.select(*fields)


def with_notional(trades: DataFrame) -> DataFrame:
    return trades.withColumn("notional", F.col("price") * F.col("volume"))


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order, some left out at the front, at most ``limit``."""
    own = rows.orderBy(*order).offset(offset)
    return own.limit(limit) if limit is not None else own


def assemble(df: DataFrame, definitions: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """Adds features (name -> needed columns, expression) in the order of their needs; a need that no column and no
    other feature meets, or a circle, is an error. Features of one depth share one projection."""
    left = dict(definitions)
    while left:
        ready = {n: c for n, (needs, c) in left.items() if all(x in df.columns for x in needs)}
        if not ready:
            raise ValueError(f"features without their needs: {sorted(left)}")
        df = df.withColumns(ready)
        left = {n: v for n, v in left.items() if n not in ready}
    return df


def joined_in_time(context: DataFrame, research: DataFrame) -> DataFrame:
    """Context rows before research rows, told apart by ``is_context``; stops where a symbol's context ends after its
    research starts or both hold one time."""
    ends = context.groupBy("symbol").agg(F.max("ts").alias("_end"))
    late = research.groupBy("symbol").agg(F.min("ts").alias("_start")).join(ends, "symbol").where("_end >= _start")
    if not late.isEmpty():
        raise ValueError("context reaches into the research rows")
    return context.withColumn("is_context", F.lit(True)).unionByName(research.withColumn("is_context", F.lit(False)))
