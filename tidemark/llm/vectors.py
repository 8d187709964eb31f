"""What the vector operators share: which vectors take part, and reference points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, of some length, without null, NaN or infinite components, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def packed(embedding: Column, width: int) -> Column:
    """The vector as doubles, with zeros up to ``width``."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    return F.concat(doubles, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(embedding)))


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column of doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def reference_points(vectors: DataFrame, count: int, key: str) -> np.ndarray:
    """At most ``count`` of the vectors, chosen by a hash of their key: the bounded sample that an index is fitted on."""
    rows = vectors.orderBy(F.xxhash64(F.lit("pivot"), key), key).limit(count).select("v").collect()
    return np.array([r["v"] for r in rows], float)


def width_of(table: DataFrame) -> int:
    """Length of the longest vector that takes part."""
    return table.where(usable(F.col("embedding"))).agg(F.max(F.size("embedding"))).first()[0] or 0
