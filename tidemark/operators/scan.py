"""Row numbers of long series, without one task per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_index(df: DataFrame, key: str = "symbol", order: str = "ts", unit: str = "month", name: str = "idx") -> DataFrame:
    """``idx`` (or another name): 0-based row number per series. Rows are numbered inside (series, clock bucket) and the bucket counts,
    a small table, are summed up before; no task holds a whole series."""
    bucket = df.withColumn("_bucket", F.date_trunc(unit, order))
    counts = bucket.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = bucket.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order)) - 1)
    return inside.join(before, [key, "_bucket"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))
