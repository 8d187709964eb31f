"""Centroid clustering of integer vectors by Orchard's search.

Every centroid has a list of the others, nearest first. A vector starts at one centroid and walks along its list; as
soon as a closer centroid is found, the walk jumps to that one's list, and centroids met before are marked and not
measured again. The walk stops when the list's next centroid lies strictly beyond twice the current distance: by the
triangle inequality no other can then be as close, ties included. Many vectors of a task walk at once, each along its
own list. All arithmetic is on integers, hence exact and the same at every partitioning.

Centroids, their lists and their sums have a fixed size (``k`` times ``width``) and are all that reaches the driver; a
task adds up its vectors before anything is shuffled. Vectors are stored once as integers and read in each round.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out; integers
are held within 2**27 of zero (components within 524,288), so that every squared distance fits a long; fewer than ``k``
vectors give fewer centroids; equal vectors and rows that repeat a vec_id count each; a null vec_id hashes as if it were
written "null"; an empty table gives an empty result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, tidy

LIMIT = 1 << 27
_LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and the integers floor(scale * x) of every vector that takes part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce((F.size(x) == width) & finite, F.lit(False)))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return kept.select("vec_id", whole.alias("v"))


def orchard_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of the others, nearest first, and their squared distances."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def orchard_search(x: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of ``x`` (smaller number among equals), its squared distance, and how many
    distances were measured. ``start``: where each row begins."""
    order, apart = lists
    best = start.astype(np.int64)
    distance = ((x - centroids[best]) ** 2).sum(1)
    marked = np.zeros((len(x), len(centroids)), bool)
    marked[np.arange(len(x)), best] = True
    step = np.zeros(len(x), np.int64)
    walking = np.arange(len(x)) if order.shape[1] else np.zeros(0, np.int64)
    measured = len(x)
    while len(walking):
        here, at = best[walking], step[walking]
        on = apart[here, at] <= 4 * distance[walking]  # strictly beyond twice the distance: stop
        walking, here, at = walking[on], here[on], at[on]
        step[walking] += 1
        met = order[here, at]
        new = ~marked[walking, met]
        who, other = walking[new], met[new]
        marked[who, other] = True
        measured += len(who)
        d = ((x[who] - centroids[other]) ** 2).sum(1)
        closer = (d < distance[who]) | ((d == distance[who]) & (other < best[who]))
        who, other, d = who[closer], other[closer], d[closer]
        best[who], distance[who], step[who] = other, d, 0
        walking = walking[step[walking] < order.shape[1]]
    return best, distance, measured


def _searched(batch: pa.RecordBatch, centroids: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
    best, distance, _ = orchard_search(x, centroids, lists, np.zeros(len(x), np.int64))
    return x, best, distance


def _sums(centroids: np.ndarray):
    """One row a centroid and task: number and sums of its vectors."""
    lists = orchard_lists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x, best, _ = _searched(batch, centroids, lists)
            count += np.bincount(best, minlength=len(centroids))
            np.add.at(total, best, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    lists = orchard_lists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, best, distance = _searched(batch, centroids, lists)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors becomes the floor of their mean; the others stay."""
    exact = "decimal(38,0)"
    parts = vectors.mapInArrow(tidy(_sums(centroids)), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast(exact)).alias(f"s{i}") for i in range(centroids.shape[1])))
    out = centroids.copy()
    for r in sums.collect():  # at most one row a centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, scale: int = 256) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    whole = stored(whole_numbers(vectors, width, scale))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = whole.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, width)
    id_type = dict(vectors.dtypes)["vec_id"]
    row = f"vec_id {id_type}, cluster int, distance long"
    if not len(centroids):
        return whole.sparkSession.createDataFrame([], row + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    found = stored(whole.mapInArrow(tidy(_assigned(centroids)), row))
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    per = [(c, min(inertia.get(c, 0), _LONG), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    about = found.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, centroid_sha256 string")
    every = F.lit(min(sum(inertia.values()), _LONG)).cast("long")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", every.alias("inertia"), "centroid_sha256")
