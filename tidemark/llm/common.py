"""Helpers that the corpus operators share: table reading, scratch tables, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    The folder is scratch space that its owner clears; a lost executor costs a reread of the files, not a recompute.
    """
    path = f"{scratch_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` cut down to the named columns and ``text`` as UTF-8 bytes, null text as empty.

    Texts go to Python workers in batches of bounded size, so that one worker holds few of them at a time.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker; asking for one drops those of other operators."""
    for other in [k for k in _CACHES if k != name]:
        del _CACHES[other]
    return _CACHES.setdefault(name, {})


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over batches, after which the worker gives memory that it no longer uses back to the machine."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)

    return run
