"""Bars as a table of series in blocks: cut, with the neighbours of each block, and kept in that order.

The table is bucketed by the block's key (series and block number) and sorted by it and time, with one file a bucket.
Windows over blocks, and folds over them, then read it without an exchange or a sort. Aggregates read its own rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.blocks import SIZE, Blocks, cut
from tidemark.sources.scratch import scratch

#: Rows before and after a block that a stored table holds unless told otherwise.
BACK, AHEAD, BUCKET_ROWS = 128, 32, 1 << 20


def write(bars: DataFrame, name: str, back: int = BACK, ahead: int = AHEAD, size: int = SIZE, buckets: int | None = None, path: str | None = None, keep: bool = False) -> Blocks:
    """Store the series of ``bars`` as table ``name`` under ``path`` (a new one in the shared folder). The number of
    buckets follows the number of rows unless given; ``keep`` as in :func:`cut`, for bars that are costly to make."""
    spark = bars.sparkSession
    blocks = cut(bars, back, ahead, size, keep)
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, -(-blocks.frame.select("__idx").count() // BUCKET_ROWS))
    ordered = blocks.frame.repartition(buckets, "symbol").sortWithinPartitions("symbol", "ts")
    ordered.write.bucketBy(buckets, "symbol").sortBy("symbol", "ts").mode("overwrite").option("path", path or scratch(spark)).saveAsTable(name)
    most = spark.table(name).agg(F.max(F.when(blocks.inside(), F.col("__block"))) + 1).first()[0] or 1
    about = json.dumps({"size": size, "back": back, "ahead": ahead, "symbol_type": blocks.symbol_type, "most": most})
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('series' = '{about}')")
    return read(spark, name)


def read(spark: SparkSession, name: str) -> Blocks:
    """The blocks of a stored table. Sets the session option by which Spark trusts the order inside a bucket's file."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    about = json.loads(spark.sql(f"SHOW TBLPROPERTIES {name} ('series')").first()["value"])
    return Blocks(spark.table(name), about["size"], about["back"], about["ahead"], about["symbol_type"], about["most"])


def drop(spark: SparkSession, name: str) -> None:
    """Forget the table; its folder is scratch space, or its owner's."""
    spark.sql(f"DROP TABLE {name}")
