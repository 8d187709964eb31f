"""Near-duplicate vectors by a pivot-permutation index.

Every distinct vector is described by its ``near`` nearest reference points, in order. The inverted list of a point has
the vectors that name it first; a vector is looked up in the lists of its first ``probe`` points. The lists of a label
lie one after the other and are cut into blocks, and a task holds two blocks, so that a long list is split and each pair
meets once. Pairs whose descriptions share at least ``min_shared`` points are verified by their cosine; a task returns
one row per vector, never a row per pair. Equal vectors are one class from the start.

Reference points are a bounded sample of the classes, of the same size for every table, without points that are closer
to one another than ``apart``: in a dense group many points would lie equally near and descriptions would not agree.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing and are components of their own; shorter vectors count as filled up with zeros; rows that repeat a
vec_id count as vectors of their own with that id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import components
from tidemark.llm.vectors import matrix, packed, reference_points, usable, width_of


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(points: np.ndarray, apart: float) -> np.ndarray:
    """Unit vectors of ``points`` in their order, without those whose cosine with an earlier one reaches ``apart``."""
    u, kept = unit(points), []
    for i, x in enumerate(u):
        if not kept or (u[kept] @ x).max() < apart:
            kept.append(i)
    return u[kept]


def _describe(points: np.ndarray, near: int, width: int):
    """Per vector its nearest points, nearest first, and the same as a bitmap."""
    words = -(-len(points) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column("v"), width))
            order = np.argsort(-(u @ points.T), axis=1, kind="stable")[:, :near].astype(np.int32)
            bits = np.zeros((len(u), 64 * words), bool)
            np.put_along_axis(bits, order, True, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("label", "number", "weight")),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel())),
                    pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()),
                    pa.array([x.tobytes() for x in u.astype("<f8")], pa.binary()),
                ],
                names=["label", "number", "weight", "order", "bits", "unit"],
            )

    return run


def _root(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows, by their links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(threshold: float, min_shared: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        u = np.frombuffer(b"".join(rows["unit"]), "<f8").reshape(len(rows), -1)
        bits = np.frombuffer(b"".join(rows["bits"]), "<u8").reshape(len(rows), -1)
        number, weight, block = (rows[c].to_numpy() for c in ("number", "weight", "block"))
        one, other = (np.arange(len(rows)),) * 2 if int(key[1]) == int(key[2]) else (np.flatnonzero(block == b) for b in (int(key[1]), int(key[2])))
        links = []
        for lo in range(0, len(one), 256):
            i = one[lo : lo + 256]
            shared = np.zeros((len(i), len(other)), np.uint16)
            for w in range(bits.shape[1]):
                shared += np.bitwise_count(bits[i, w][:, None] & bits[other, w][None, :])
            a, b = np.nonzero(shared >= min_shared)
            a, b = i[a], other[b]
            if one is other:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 17):
                x, y = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
                linked = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
                links.append((x[linked], y[linked]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*links) if links else ((), ())))
        n = (np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))).astype(np.int64)
        has, root = n > 0, _root(len(rows), a, b)
        return pd.DataFrame({"number": number[has], "other": number[root[has]], "n": n[has]})

    return run


def link_vectors(table: DataFrame, threshold: float = 0.98, points: int = 1024, near: int = 32, probe: int = 16, min_shared: int = 8, apart: float = 0.9, block: int = 768) -> DataFrame:
    """``table``: vec_id, embedding, label. Per row: vec_id, n_links, component_id, kept."""
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    width = width_of(table)
    rows = stored(table.select("vec_id", "label", F.when(takes_part, packed(F.col("embedding"), width)).alias("v")))
    own = rows.where(F.col("v").isNotNull())
    classes = stored(own.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("number", F.monotonically_increasing_id()))
    reference = reference_points(classes, points, "least")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(reference):
        return alone
    reference = spread(reference, apart)
    shared = min(min_shared, -(-min(near, len(reference)) // 4))
    label_type = dict(table.dtypes)["label"]
    posted = stored(classes.mapInArrow(_describe(reference, near, width), f"label {label_type}, number long, weight long, order array<int>, bits binary, unit binary").withColumn("point", F.col("order")[0]))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("label").orderBy("point").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lists = posted.groupBy("label", "point").agg(F.count("*").alias("length")).withColumn("first", before)
    entry = F.struct("first", "length", F.floor(F.col("first") / block).cast("int").alias("lo"), F.floor((F.col("first") + F.col("length") - 1) / block).cast("int").alias("hi"))
    lists = stored(lists.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("point", entry))).alias("lists")))
    both = posted.join(F.broadcast(lists) if lists.count() <= 1000 else lists, "label")
    cut = both.withColumn("own", F.col("lists")[F.col("point")]).withColumn("block", F.floor((F.col("own")["first"] + F.pmod(F.xxhash64("number"), F.col("own")["length"])) / block).cast("int"))
    asked = F.filter(F.transform(F.slice("order", 1, probe), lambda p: F.try_element_at("lists", p)), lambda x: x.isNotNull())
    dealt = cut.withColumn("partner", F.explode(F.array_distinct(F.flatten(F.transform(asked, lambda x: F.sequence(x["lo"], x["hi"]))))))
    dealt = dealt.select("label", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "number", "weight", "block", "bits", "unit")
    found = stored(dealt.groupBy("label", "i", "j").applyInPandas(_link(threshold, shared), "number long, other long, n long"))
    links = stored(found.groupBy("number").agg(F.sum("n").alias("n")))
    groups = components(found.select(F.col("number").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "number"})
    joined = stored(classes.join(links, "number", "left").join(groups, "number", "left").withColumn("component", F.coalesce("component", "number")))
    least = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    per_class = stored(joined.join(least, "component").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    linked = own.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
