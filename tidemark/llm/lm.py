"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary (every distinct word of both corpora), one order and one
smoothing. A document's score is the mean, over its words, of the loss under the target model less the loss under the
background model: the lower, the closer to the target. Both models are counted over all their texts, and the background
model leaves out the document that it scores: a text seen nowhere else does not pass for well known.

P(w | v) = (count(v w) + m P(w)) / (count(v) + m), P(w) from counts with half a count added to each word; the end of a
text takes what is left of the mass after v. Only the sizes (words in all, distinct words) are gathered. Counts of
words and word pairs grow with the corpus and stay spread out: documents form chunks, each chunk sends its distinct
keys with their counts to ranges of the key space, every range adds up its keys over all chunks and sends the totals
back, and the chunk works out the losses of its documents. A key that all texts share travels once for each chunk.
Keys are hashes of 32 bits and those of the range's number, which grows with the corpus.

Defined results: null text is empty; an empty text has no words, null losses and score 0; rows that repeat a doc_id
are scored each, each without itself alone; an empty target gives a uniform target model; an empty table gives an empty
result; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, text_rows, tidy
from tidemark.llm.corpus_counts import ROW, placed, range_bits, row_batch, runs, squeezed, unsqueezed
from tidemark.llm.tokens import strings

CHUNK_DOCS, CHUNK_BYTES, RANGE_KEYS = 1024, 6_000_000, 2_000_000
START = np.uint64(0x9E3779B97F4A7C14)
_FIRST, _SECOND = mix(np.array([1, 2], np.uint64)) | np.uint64(1)
TARGET = 1 << 61


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, lower-cased and split as ASCII: their number in each text, distinct hashes, and each word's place there."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(some)]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.encode, coded.dictionary.to_pylist())), np.uint64, len(coded.dictionary))
    return np.diff(before[cut]), hashes, coded.indices.to_numpy()


class Chunk:
    """Keys of some documents: ``keys`` sorted and distinct, their ``counts``, and the places there of every word, the
    word before it and their pair."""

    def __init__(self, length: np.ndarray, hashes: np.ndarray, code: np.ndarray):
        self.length, self.doc = length, np.repeat(np.arange(len(length)), length)
        begins = (np.cumsum(length) - length)[length > 0]
        word = hashes[code]
        before = np.r_[START, word[:-1]] if len(word) else word
        before[begins] = START
        pair = mix(before * _FIRST + word * _SECOND) | np.uint64(1)
        every = np.concatenate([pair, hashes[code] & ~np.uint64(1), np.full(len(begins), START)])
        self.keys, place, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.pair, self.word = place[: len(word)], place[len(word) : 2 * len(word)]
        self.before = np.r_[0, self.word[:-1]] if len(word) else self.word
        self.starts = np.zeros(len(word), bool)
        self.starts[begins] = True
        self.before[begins] = np.searchsorted(self.keys, START)

    def own(self, place: np.ndarray) -> np.ndarray:
        """How often the key at each place occurs in the document that holds it."""
        _, at, count = np.unique(self.doc * np.int64(len(self.keys) + 1) + place, return_inverse=True, return_counts=True)
        return count[at]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.StringArray]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            ids += part.column("doc_id").to_pylist()
            texts.append(strings(part.column("text")))
            size += texts[-1].nbytes
            if len(ids) >= CHUNK_DOCS or size > CHUNK_BYTES:
                yield ids, pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def _scatter(bits: int, flag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = flag | ((task.partitionId() if task else 0) << 24)
        for number, (ids, texts) in enumerate(_chunks(batches), number):
            length, hashes, code = words(texts)
            chunk = Chunk(length, hashes, code)
            rows = []
            if not flag:
                small = code.astype("<u2" if len(hashes) <= 1 << 16 else "<u4")
                rows.append((-1 - number, number, _ids(ids), length.astype("<i4").tobytes(), hashes.astype("<u8").tobytes(), squeezed(small)))
            ranges, names = placed(chunk.keys, bits)
            first, size = runs(ranges)
            counts = chunk.counts.astype("<u4")
            rows += [(int(ranges[a]), number, names[a : a + n].tobytes(), squeezed(counts[a : a + n]), b"", b"") for a, n in zip(first.tolist(), size.tolist())]
            for lo in range(0, len(rows), 4096):
                yield row_batch(rows[lo : lo + 4096])

    return run


def _ids(ids: list) -> bytes:
    """doc_ids and which of them are null."""
    return np.array([i is None for i in ids], "u1").tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One range: what each key of a chunk counts in the background and in the target corpus."""
    if key[0] < 0:
        return rows
    is_target = (rows["chunk"] >= TARGET).to_numpy()
    names = [np.frombuffer(x, "<u4") for x in rows["a"]]
    weight = np.concatenate([unsqueezed(x, "<u4") for x in rows["b"]]).astype(np.int64)
    size = list(map(len, names))
    every, aimed = np.concatenate(names), np.repeat(is_target, size)
    order = np.argsort(every, kind="stable")
    first, length = runs(every[order])
    # totals of 64 bits; the upper bytes, mostly 0, cost next to nothing byte plane by byte plane
    counts = np.empty((2, len(every)), "<i8")
    for k, own in enumerate((~aimed, aimed)):
        total = np.add.reduceat((weight * own)[order], first)
        counts[k, order] = np.repeat(total, length)
    ends = np.cumsum(size)
    out = [(key[0], c, squeezed(counts[0, b - n : b]), squeezed(counts[1, b - n : b]), b"", b"") for c, b, n, aim in zip(rows["chunk"], ends, size, is_target) if not aim]
    return pd.DataFrame(out, columns=["key", "chunk", "a", "b", "c", "d"])


def _scores(prior: float, vocabulary: int, background: int, target: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        head, answers = rows.iloc[0], rows.iloc[1:]
        length, hashes = np.frombuffer(head["b"], "<i4").astype(np.int64), np.frombuffer(head["c"], "<u8")
        null, ids = np.frombuffer(head["a"][: len(length)], "u1") != 0, np.frombuffer(head["a"][len(length) :], "<i8")
        chunk = Chunk(length, hashes, unsqueezed(head["d"], "<u2" if len(hashes) <= 1 << 16 else "<u4"))
        around, aim = (np.concatenate([np.zeros(0), *(unsqueezed(x, "<i8") for x in answers[c])]) for c in ("a", "b"))
        pair, word = chunk.own(chunk.pair), chunk.own(chunk.word)
        before = np.where(chunk.starts, 1, np.r_[0, word[:-1]] if len(word) else word)

        def loss(count: np.ndarray, total: int, pair, word, before, own) -> np.ndarray:
            single = (count[chunk.word] - word + 0.5) / (total - own + 0.5 * vocabulary)
            return -np.log((count[chunk.pair] - pair + prior * single) / (count[chunk.before] - before + prior))

        of_target = np.bincount(chunk.doc, loss(aim, target, 0, 0, 0, 0), len(length))
        of_others = np.bincount(chunk.doc, loss(around, background, pair, word, before, length[chunk.doc]), len(length))
        doc_id = pd.array(ids, dtype="Int64")
        doc_id[null] = pd.NA
        some, n = length > 0, np.maximum(length, 1)
        return pd.DataFrame({"doc_id": doc_id, "n_tokens": length, "target_loss": np.where(some, of_target / n, np.nan), "background_loss": np.where(some, of_others / n, np.nan), "score": np.where(some, (of_target - of_others) / n, 0.0)})

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the distinct words of a chunk, and the words of the chunk beside the first of them."""
    for _, texts in _chunks(batches):
        length, hashes, _ = words(texts)
        n = np.zeros(len(hashes), np.int64)
        n[:1] = length.sum()
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["word", "n"])


def score_documents(docs: DataFrame, target: DataFrame, prior: float = 5.0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score. ``target``: text."""
    bits = range_bits(docs, RANGE_KEYS)
    own = text_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    aim = text_rows(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), "doc_id")
    seen = [t.mapInArrow(tidy(_distinct), "word long, n long").select("*", F.lit(k).alias("corpus")) for k, t in enumerate((own, aim))]
    sizes = seen[0].unionByName(seen[1]).agg(F.approx_count_distinct("word", 0.01), *(F.sum(F.when(F.col("corpus") == k, F.col("n"))) for k in (0, 1))).first()
    vocabulary, background, aimed = (int(x or 0) for x in sizes)
    keys = own.mapInArrow(tidy(_scatter(bits, 0)), ROW).unionByName(aim.mapInArrow(tidy(_scatter(bits, TARGET)), ROW))
    counted = keys.groupBy("key").applyInPandas(_count, ROW)
    scored = counted.groupBy("chunk").applyInPandas(_scores(prior, max(vocabulary, 1), background, aimed), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    return scored.select("doc_id", "n_tokens", F.nanvl("target_loss", F.lit(None)).alias("target_loss"), F.nanvl("background_loss", F.lit(None)).alias("background_loss"), "score")
