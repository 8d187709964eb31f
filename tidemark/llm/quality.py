"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word bucket has a sparse ternary index vector; its word vector is the sum of the index vectors of its neighbours
over all documents of the corpus. Words and their shapes (letter case, digits, marks) are two such vocabularies of
fixed size, so the vectors that tasks exchange and broadcast have a proven bound. A document is pooled to the mean and
spread of its vectors and the agreement of neighbours. A two-layer numpy network, fitted on at most ``max_train``
labelled documents, gives a logit; a temperature fitted on a part of them that the network did not see calibrates it.

Only the text enters a score. Defined results: null text is empty, and an empty text is scored like any other;
repeated rows get equal scores; without a label of each class every score is the share of label 1, or 0.5; labels of
one document that disagree count by their majority, label 1 on a tie; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import is_held_out, mix, text_rows, tidy, worker_cache

WORDS, SHAPES, DIM, SHAPE_DIM, REACH = 1 << 14, 1 << 9, 24, 8, 2
THRESHOLD = 0.3
SLICES, FAN_IN = 32, 256

_LETTERS = dict.fromkeys(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäçèéêëîïôöùûüßáíóúñÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÁÍÓÚÑ"))


def shape(word: str) -> str:
    """Case of a word, and its first marks and digits with the letters taken out."""
    case = "U" if word.isupper() else "l" if word.islower() else "T" if word.istitle() else "M"
    return case if word.isalpha() else case + word[:40].translate(_LETTERS)[:4]


def codes(text: str) -> np.ndarray:
    """word bucket * SHAPES + shape bucket of each word."""
    known, out = worker_cache("quality"), []
    for w in text.split():
        c = known.get(w)
        if c is None:
            c = (xxhash.xxh3_64_intdigest(w) % WORDS) * SHAPES + xxhash.xxh3_64_intdigest(shape(w)) % SHAPES
            if len(known) < 100_000:
                known[w] = c
        out.append(c)
    return np.array(out, np.int64)


@lru_cache(None)
def index_vectors(buckets: int, dim: int) -> np.ndarray:
    """Sparse ternary vectors: about one entry in eight is set, each from a hash of its place."""
    h = mix(np.arange(buckets * dim, dtype=np.uint64) + np.uint64(buckets) * np.uint64(0x9E3779B97F4A7C15 % (1 << 32)))
    return (np.where(h % np.uint64(8) == 0, 1.0, 0.0) * np.where(h >> np.uint64(63) == 0, 1.0, -1.0)).reshape(dim, buckets).astype(np.float32)


def _accumulate(into: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> None:
    """Add to ``into`` (dim x buckets) the index vectors of the neighbours of each word."""
    near = index_vectors(into.shape[1], into.shape[0])[:, ids]
    context = np.zeros(near.shape, np.float32)
    for step in range(1, REACH + 1):
        same = doc[step:] == doc[:-step]
        context[:, :-step] += near[:, step:] * same
        context[:, step:] += near[:, :-step] * same
    for d in range(len(into)):
        into[d] += np.bincount(ids, weights=context[d], minlength=into.shape[1])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, shapes = np.zeros((DIM, WORDS)), np.zeros((SHAPE_DIM, SHAPES))

    def add(chunk):
        both = np.concatenate(chunk)
        doc = np.repeat(np.arange(len(chunk)), [len(x) for x in chunk])
        _accumulate(words, both // SHAPES, doc)
        _accumulate(shapes, both % SHAPES, doc)

    chunk, n = [], 0
    for batch in batches:
        for raw in batch.column("text"):
            chunk.append(codes(raw.as_py().decode("utf-8", "replace")))
            n += len(chunk[-1])
            if n > 100_000:
                add(chunk)
                chunk, n = [], 0
    if chunk:
        add(chunk)
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    flat = np.concatenate([words.ravel(), shapes.ravel()]).astype("<f4")
    cuts = np.array_split(flat, SLICES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["slice", "part", "sums"])


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<f4").astype(float) for x in rows.sort_values("part")["sums"])
    return pd.DataFrame({"slice": [np.int32(key[0])], "part": [np.int32(key[1])], "sums": [total.astype("<f4").tobytes()]})


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centred unit vectors of all word and shape buckets, from all documents; a few MB at any size of corpus."""
    parts = text_rows(docs)
    kind = "slice int, part int, sums binary"
    sums, n = parts.mapInArrow(tidy(_contexts), kind), parts.rdd.getNumPartitions()
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInPandas(_add, kind)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    rows = {r["slice"]: r["sums"] for r in sums.toLocalIterator()}
    flat = np.concatenate([np.frombuffer(rows[k], "<f4") for k in range(SLICES)]) if rows else np.zeros(WORDS * DIM + SHAPES * SHAPE_DIM, np.float32)
    out = []
    for x in (flat[: WORDS * DIM].reshape(DIM, WORDS).T, flat[WORDS * DIM :].reshape(SHAPE_DIM, SHAPES).T):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.maximum(size, 1e-9)
        unit -= unit[size[:, 0] > 0].mean(0) if (size > 0).any() else 0
        unit[size[:, 0] == 0] = 0
        out.append((unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32))
    return out[0], out[1]


FEATURES = 2 * (DIM + SHAPE_DIM) + 6


def pooled(code: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors, agreement of neighbours, repeats and length of one document."""
    out = np.zeros(FEATURES, np.float32)
    n = len(code)
    if not n:
        return out
    w, s = words[code // SHAPES], shapes[code % SHAPES]
    mean_w, mean_s = w.mean(0), s.mean(0)
    out[:DIM], out[DIM : DIM + SHAPE_DIM] = mean_w, mean_s
    at = DIM + SHAPE_DIM
    out[at : at + DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", w, w) / n - mean_w**2, 0))
    out[at + DIM : at + DIM + SHAPE_DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", s, s) / n - mean_s**2, 0))
    if n > 1:
        out[-6] = np.einsum("ij,ij->", w[1:], w[:-1]) / (n - 1)
        out[-5] = np.einsum("ij,ij->", s[1:], s[:-1]) / (n - 1)
        out[-4] = np.mean(code[1:] == code[:-1])
    out[-3] = len(np.unique(code)) / n
    out[-2] = np.log1p(n) / 5
    out[-1] = 1
    return out


class Network:
    """Two layers: tanh units under a logistic unit; ``temperature`` divides the logit."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on four fifths; the weights of the epoch with the least loss on the rest, which then sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    k = x.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(mean, scale, p[0], p[1], np.zeros(hidden), np.log(share / (1 - share)), 1.0)
    z = (x - mean) / scale
    order = rng.permutation(len(z))
    aside, own = order[: max(1, len(z) // 5)], order[max(1, len(z) // 5) :]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best = (np.inf, p)
    for epoch in range(epochs):
        rate = 4e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for lo in range(0, len(own), 128):
            at = own[(perm := rng.permutation(len(own)) if lo == 0 else perm)[lo : lo + 128]]
            a = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(d, p[2]) * (1 - a * a)
            grads = [z[at].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        now = _loss(np.tanh(z[aside] @ p[0] + p[1]) @ p[2] + p[3], y[aside])
        if now < best[0]:
            best = (now, [np.copy(a) for a in p])
    p = best[1]
    logit = np.tanh(z[aside] @ p[0] + p[1]) @ p[2] + p[3]
    temperatures = np.geomspace(0.25, 8, 81)
    temperature = float(temperatures[np.argmin([_loss(logit / q, y[aside]) for q in temperatures])])
    return Network(mean, scale, *p, temperature)


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = vectors.value
        for batch in batches:
            rows = [pooled(codes(t.as_py().decode("utf-8", "replace")), words, shapes).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], names=["quality", "features"])

    return run


def _scored(vectors, network: Network, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = vectors.value
        for batch in batches:
            x = np.array([pooled(codes(t.as_py().decode("utf-8", "replace")), words, shapes) for t in batch.column("text")], float).reshape(-1, FEATURES)
            score = network.scores(x)
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000):
    """Word vectors (broadcast) and the network. ``labels``: doc_id, quality; rows to learn from only."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    votes = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = text_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "quality").mapInArrow(tidy(_features(vectors)), "quality int, features binary").collect()
    rows = sorted((bytes(r["features"]), r["quality"]) for r in rows)
    x = np.array([np.frombuffer(f, "<f4") for f, _ in rows], float).reshape(-1, FEATURES)
    return vectors, fit(x, np.array([q for _, q in rows], float))


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of held-out documents (crc32 mod 5 is 0) are not used."""
    vectors, network = train(docs, labels.where(~is_held_out(F.col("doc_id"))), max_train)
    id_type = dict(docs.dtypes)["doc_id"]
    rows = text_rows(docs, "doc_id").mapInArrow(tidy(_scored(vectors, network, threshold)), f"doc_id {id_type}, score double, predicted int")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with their columns as they were. The text is read once to score
    it and stays in the row: score and row are never joined."""
    vectors, network = train(docs, labels.where(~is_held_out(F.col("doc_id"))), max_train)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = vectors.value
        for batch in batches:
            x = np.array([pooled(codes(t or ""), words, shapes) for t in batch.column("text").to_pylist()], float).reshape(-1, FEATURES)
            yield batch.filter(pa.array(network.scores(x) >= threshold))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return docs.mapInArrow(tidy(run), schema)
