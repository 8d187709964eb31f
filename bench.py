"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import risk as K
from tidemark.operators import windows as W
from tidemark.queries import QUERIES
from tidemark.sources import series

HEADLINE = [
    "agg01_bars_from_ticks", "agg01_hourly_bars", "agg02_weekly_bars_vwap", "win01_returns", "win02_rolling_statistics", "win07_bands", "win14_simple_oscillators", "win16_ema_macd",
    "win20_volatility_features", "win27_crossovers", "agg05_descriptive", "agg18_ratios", "agg21_correlation_matrix", "agg25_regression", "agg58_trade_summary", "joi05_forward_as_of",
    "res01_joi07_outcomes", "res03_flagship_conditional_hit_rate", "res11_prior_rate_by_fold", "qa07_validation_report", "qa16_dataset_digest", "top04_parameter_sweep", "win23_drawdowns", "prj03_quotes",
]


def long_series(spark: SparkSession, sf_dir: str, rows: int):
    """Bars of 2,000 series, ``rows`` and a few more, made by repeating the given events' values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    copies = -(-rows // max(events.count(), 1))
    place = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    close = 100 + F.col("value") * (1 + F.col("k") % 7 / 10)
    return place.select((F.col("event_id") % 2000).alias("symbol"), F.timestamp_seconds(F.col("event_id").cast("long") * 20 + F.col("k").cast("long") * 86400 * 30).alias("ts"), close.alias("open"), (close + 1).alias("high"), (close - 1).alias("low"), close.alias("close"), F.lit(1.0).alias("volume"))


def millions(spark: SparkSession, sf_dir: str, rows: int) -> dict[str, float]:
    """Seconds over ``rows`` bars, the size that the published figures are for. Bars are first written as a series store
    (``store``, once), as the published figures start from bars in memory in order; returns are a table of their own for
    what starts from returns."""
    folder = spark.conf.get("spark.checkpoint.dir")
    long_series(spark, sf_dir, rows).write.mode("overwrite").parquet(f"{folder}/bench-long")
    began = time.time()
    bars = series.write(spark.read.parquet(f"{folder}/bench-long"), "bench_long", back=32, ahead=0)
    out = {"store": round(time.time() - began, 3)}
    W.returns(bars).withColumnRenamed("ret", "r").write.mode("overwrite").parquet(f"{folder}/bench-returns")
    with_r = spark.read.parquet(f"{folder}/bench-returns")
    moments = [F.count("r"), F.avg("r"), F.stddev_samp("r"), F.skewness("r"), F.kurtosis("r")]
    jobs = {
        "returns": lambda: W.returns(bars),
        "rolling_volatility_21": lambda: W.return_volatility(bars, 21),
        "return_statistics": lambda: with_r.groupBy("symbol").agg(*moments),
        "risk_ratios": lambda: K.ratios(with_r, "r"),
        "hourly_bars": lambda: B.resample(bars.rows(), 3600),
    }
    for name, job in jobs.items():
        times = []
        for _ in range(2):
            began = time.time()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        out[name] = round(min(times), 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the second run is warm
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(min(times), 3)
    rows = int(os.environ.get("BENCH_ROWS", "10000000"))
    long = millions(spark, sf_dir, rows) if rows else {}
    print(json.dumps({"metric": "total_seconds_warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "long_rows": rows, "long_seconds": long}))


if __name__ == "__main__":
    main()
