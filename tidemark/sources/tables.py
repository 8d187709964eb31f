"""Bars as partitioned Parquet with a catalog of datasets, and other sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import dataset_digest


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Column names in lower case; the time column under any of its names becomes ``ts``."""
    df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    time = next((c for c in ("ts", "time", "timestamp", "datetime", "date") if c in df.columns), None)
    if time is None:
        raise ValueError("no time column")
    return df.withColumnRenamed(time, "ts")


def register(spark: SparkSession, name: str, path: str) -> None:
    load_parquet(spark, path).createOrReplaceTempView(name)


def save(bars: DataFrame, path: str) -> DataFrame:
    """Write bars by symbol; returns the catalog: one row per symbol with count, span and digest."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)
    return catalog(bars)


def catalog(bars: DataFrame) -> DataFrame:
    digest = dataset_digest(bars, ["ts", "open", "high", "low", "close", "volume"], "symbol")
    span = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return span.join(digest, "symbol")


def overlapping(catalog_rows: DataFrame, start, end, timeframe: str | None = None, tag: str | None = None) -> DataFrame:
    """Datasets whose span touches [start, end]; of a timeframe and with a tag where those are named."""
    got = catalog_rows.where((F.col("first_ts") <= F.lit(end).cast("timestamp")) & (F.col("last_ts") >= F.lit(start).cast("timestamp")))
    if timeframe is not None:
        got = got.where(F.col("timeframe") == timeframe)
    return got if tag is None else got.where(F.array_contains("tags", tag))


def verify(catalog_rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Datasets whose stored digest differs from the one of the bars."""
    now = dataset_digest(bars, ["ts", "open", "high", "low", "close", "volume"], "symbol").select("symbol", F.col("digest").alias("now"))
    return catalog_rows.join(now, "symbol", "full_outer").where(~F.col("digest").eqNullSafe(F.col("now"))).select("symbol", "digest", "now")


def write_signals(signals: DataFrame, path: str) -> None:
    """Signals (symbol, ts, valid_from, signal, confidence) after :func:`signal_faults` finds nothing."""
    if not signal_faults(signals).isEmpty():
        raise ValueError("signals are valid before they are known, repeated, or out of range")
    signals.write.mode("overwrite").option("header", True).csv(path)


def signal_faults(signals: DataFrame) -> DataFrame:
    """Signals known only after they are valid, repeated, or with a confidence outside 0 to 1."""
    early = signals.where(F.col("valid_from") < F.col("ts")).select("symbol", "ts", F.lit("early").alias("fault"))
    twice = signals.groupBy("symbol", "ts").agg(F.count("*").alias("n")).where("n > 1").select("symbol", "ts", F.lit("twice").alias("fault"))
    odd = signals.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).select("symbol", "ts", F.lit("confidence").alias("fault"))
    return early.unionByName(twice).unionByName(odd)


def records(spark: SparkSession, path: str, symbol: str, start, end, limit: int | None = None) -> DataFrame:
    """Bars of one dataset between two times, both included, in time order; only that symbol's folder is read."""
    own = load_parquet(spark, path).where((F.col("symbol") == symbol) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy("ts")
    return own.limit(limit) if limit is not None else own


def export_dataset(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Aligned features and labels as CSV and as JSON lines under ``path``; returns both as read again."""
    rows.write.option("header", True).csv(f"{path}/csv")
    rows.write.json(f"{path}/json")
    spark = rows.sparkSession
    return spark.read.option("header", True).schema(rows.schema).csv(f"{path}/csv"), spark.read.schema(rows.schema).json(f"{path}/json")
