"""Target-distribution importance resampling over hashed n-grams.

A document's features are its runs of one to three consecutive words. A table of 256 bytes lower-cases A-Z and blanks
every separator of the UTF-8 text, ``bytes.split`` cuts it into words, and the checksum of a longer run goes on from
the checksum of the run without its last word, so that each run costs the bytes of one word. The checksum modulo
``buckets`` is the feature's bucket. Counters add up the buckets of a task; Spark adds up the tasks. A bucket's gain is
the logarithm of its share among the target's features over its share in the documents, in thousandths; a document
weighs the sum of its gains, and a Gumbel number drawn from its id makes the highest scores a sample without return.

Two scans of the documents: one for the counts, one for the weights. Only the counts of the buckets, of a fixed number,
reach the driver. The order of all documents is a distributed sort: its places are numbered within partitions and moved
on by the sizes of the partitions before.

Defined results: null and empty texts have no features and weigh 0; documents under ``least_words`` words have no rank;
equal scores rank by smaller doc_id, rows that repeat a doc_id and its score in any order; a null doc_id draws as if it
were written "null" and comes last among its equals; an empty target makes every gain one over the documents' shares
alone; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_rows, tidy

BUCKETS, LONGEST = 10_000, 3
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower case for A-Z, a blank for every other ASCII byte outside 0-9 and a-z, other bytes as they are.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    # split() without an argument cuts at ASCII white space only, and the table leaves no other than blanks
    return text.translate(TABLE).split()


def checksums(tokens: list[bytes], longest: int = LONGEST) -> Iterator[int]:
    """CRC-32 of every run of 1 to ``longest`` words joined by one blank: the run's seed is the run one word shorter."""
    last = list(map(crc32, tokens))
    out = [last]
    further = [b" " + w for w in tokens]
    for n in range(1, longest):
        last = list(map(crc32, further[n:], last))
        out.append(last)
    return chain.from_iterable(out)


def bucket_numbers(tokens: list[bytes], buckets: int, longest: int = LONGEST) -> np.ndarray:
    return np.fromiter(checksums(tokens, longest), np.int64) % buckets


def _counted(buckets: int):
    """Buckets of a task's texts, added up in one Counter: at most ``buckets`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(bucket_numbers(words(text.as_py()), buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket."""
    rows = text_rows(texts).mapInArrow(tidy(_counted(buckets)), "bucket int, n long")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    n, s, t = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that the id and the seed fix."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens = words(text.as_py())
                features = bucket_numbers(tokens, len(gain))
                weight = int(gain[features].sum())
                rows.append((len(tokens), len(features), weight, weight + gumbel(doc_id, seed)))
            columns = list(zip(*rows)) or [()] * 4
            names = ["n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *names])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank, null for those not drawn.

    ``percent`` of the documents with ``least_words`` words are drawn, highest score first. ``target``: text.
    """
    gain = gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select("text"), buckets))
    id_type = dict(docs.dtypes)["doc_id"]
    scored = stored(text_rows(docs.select("doc_id", "text"), "doc_id").mapInArrow(tidy(_scored(gain, seed)), f"doc_id {id_type}, n_words long, n_features long, weight long, score long"))
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # the number holds the partition in its upper bits and the place there in the lower 33
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    at = F.shiftright("_m", 33)
    sizes = sorted((r["p"], r["n"], r["able"]) for r in placed.groupBy(at.alias("p")).agg(F.count("*").alias("n"), F.count(F.when(able, 1)).alias("able")).collect())
    drawn = percent * sum(a for *_, a in sizes) // 100
    before, seen = [], 0
    for p, n, _ in sizes:
        before.append((p, seen))
        seen += n
    # one row a partition of the sort
    offsets = placed.sparkSession.createDataFrame(before or [(0, 0)], "_p long, _before long")
    rank = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), at == F.col("_p")).select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
