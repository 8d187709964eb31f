"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``near`` nearest reference points. Vectors are dealt into blocks; within a
block each point has an inverted file of the vectors that name it, with the rank they give it. A query reads the files
of its own first ``probe`` points and no others. Vectors met in at least ``min_shared`` files are ranked by the footrule
distance of the two orders, a point that one order lacks standing behind its last; the nearest of them, up to a
``rerank`` share of the block, are reranked by the inner product. Should the files hold fewer than k vectors, the rest
of the block is compared too. Queries meet every block of vectors, in blocks of their own.

The measure is the inner product of the original vectors in double precision. Where lengths differ, one more
component brings all vectors to one length before they are compared with the points.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as query or
candidate; shorter vectors count as filled up with zeros; ties go to the smaller vec_id; a query has fewer rows if
there are fewer candidates; rows that repeat a vec_id are one candidate each, and no query finds its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.vectors import matrix, packed, reference_points, usable, width_of


def lengthen(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all vectors have the length ``longest`` and the measure orders as distance does."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))[:, None]])


def _describe(points: np.ndarray, longest: float, near: int, width: int):
    """Each vector's nearest points, nearest first, as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width)
            order = np.argsort(-(lengthen(x, longest) @ points.T), axis=1, kind="stable")[:, :near].astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array([r.tobytes() for r in order], pa.binary())], names=["vec_id", "vector", "near"])

    return run


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added up in the order of the components."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _search(points: int, probe: int, min_shared: int, rerank: float, k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        queries, base = rows[asks], rows[~asks].sort_values("vec_id")
        if not len(base) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype=np.int64), "vec_id": pd.Series(dtype=np.int64), "score": pd.Series(dtype=float)})
        ids = base["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(base["vector"]), "<f8").reshape(len(base), -1)
        order = np.frombuffer(b"".join(base["near"]), "<u2").reshape(len(base), -1)
        near = order.shape[1]
        by_point = np.argsort(order, axis=None, kind="stable")
        ends = np.searchsorted(order.ravel()[by_point], np.arange(points + 1)).tolist()
        member, theirs = by_point // near, (by_point % near).astype(np.int32)
        most = max(int(np.ceil(rerank * len(base))), 2 * k)
        out = []
        for query, vector, prefix in zip(queries["vec_id"], queries["vector"], queries["near"]):
            asked = np.frombuffer(prefix, "<u2")[:probe].tolist()
            files = [slice(ends[p], ends[p + 1]) for p in asked]
            met = np.concatenate([member[f] for f in files])
            closer = near - np.concatenate([np.maximum(theirs[f], rank) for rank, f in enumerate(files)])
            shared = np.bincount(met, minlength=len(base))
            first = np.flatnonzero((shared >= min_shared) & (ids != query))
            if len(first) < k:
                first = np.flatnonzero(ids != query)
            elif len(first) > most:
                footrule = -np.bincount(met, closer, len(base))[first]
                first = first[np.argpartition(footrule, most)[:most]]
            q = np.frombuffer(vector, "<f8")
            rough = x[first] @ q
            if len(first) > 4 * k:
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                first = first[rough >= cut - 1e-9 * (1 + abs(cut))]
            score = inner(x[first], q)
            best = np.lexsort((ids[first], -score))[:k]
            out.append((np.full(len(best), query), ids[first][best], score[best]))
        q, v, s = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 20, points: int = 2048, near: int = 64, probe: int = 64, min_shared: int = 2, rerank: float = 0.1, block: int = 8192) -> DataFrame:
    """``table``: vec_id, embedding. Returns query_id, rank, vec_id, score for the rows that ``is_query`` picks.

    ``points``: reference points, a sample of the rows chosen by hash, of the same size for every table.
    """
    part = table.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    width = width_of(table)
    rows = stored(part.select("vec_id", packed(F.col("embedding"), width).alias("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    id_type = dict(table.dtypes)["vec_id"]
    n, longest = rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    if not n:
        return table.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    reference = reference_points(rows, points, "vec_id")
    blocks = max(1, -(-n // block))
    index = stored(rows.mapInArrow(_describe(lengthen(reference.reshape(-1, width), longest or 1.0), longest or 1.0, near, width), f"vec_id {id_type}, vector binary, near binary"))
    asked = index.where(is_query)
    query_blocks = max(1, -(-asked.count() // block))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    base = index.select("*", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("i")).withColumn("j", every(query_blocks))
    asked = asked.select("*", F.lit(True).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("j")).withColumn("i", every(blocks))
    found = base.unionByName(asked).groupBy("i", "j").applyInPandas(_search(len(reference), probe, min_shared, rerank, k), f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
