"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens: a longer one is cut into full pieces, and what is over is its
first piece. Full pieces fill a sequence each. The others are dealt into blocks of about ``block_items``; every block
has ``islands`` islands, each a small population of packings in one task. A crossover injects the best-filled bins of
one parent whole into the other, removes the bins that repeat their pieces, and best-fits the displaced pieces again.
Between rounds the best packing of each island migrates to the next island of its block. At the end the pieces of bins
that are not full are dealt anew into blocks of about the same size, as long as that leaves fewer of them; where pieces
cannot fill bins, each block keeps its bins as they are.

Defined results: null text is empty and has one token (the end mark); repeated rows are packed each; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_rows, tidy
from tidemark.llm.tokens import encoder, strings

CAPACITY, END = 1024, 2
#: Loose pieces of so many blocks are packed in one at the end; levels stop when more than this share stays loose.
LAST_BLOCKS, STALLED = 4, 0.9


def _pieces(path: str, pattern: str, capacity: int, end: int, limit: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mark = encoder(path, pattern), np.array([end], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, limit):
                part = batch.slice(lo, limit)
                docs, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(coder.encode_batch(strings(part.column("text")))):
                    ids = np.concatenate([ids, mark])
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        docs.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. ``path``: JSON file of the vocabulary."""
    id_type = dict(docs.dtypes)["doc_id"]
    return text_rows(docs, "doc_id").mapInArrow(tidy(_pieces(path, pattern, capacity, end)), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# A packing is a list of bins; a bin is a list of item numbers. ``size`` has an item's tokens.


def best_fit(items: list[int], size: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """``items`` from the largest down, each into the fullest bin that has room; ``bins`` are extended in place."""
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - size[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > size[i]:
                insort(room, (left - size[i], k))
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    """Mean square fill: prefers few and unequally filled bins."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: Random) -> list[list[int]]:
    """The best-filled bins of ``a`` go whole into ``b``; bins of ``b`` that repeat an item fall apart."""
    full = sorted(a, key=lambda x: -sum(size[i] for i in x))
    injected = full[: max(1, int(len(full) * rng.uniform(0.3, 0.7)))]
    taken = {i for x in injected for i in x}
    kept, loose = [], []
    for x in b:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    return best_fit(loose, size, [list(x) for x in injected] + kept, capacity)


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng: Random) -> list[list[int]]:
    """The worst-filled bins and a few others fall apart and are best-fitted again."""
    order = sorted(range(len(bins)), key=lambda k: sum(size[i] for i in bins[k]))
    gone = {*order[: 1 + len(bins) // 50], *rng.sample(order, min(len(order), 1 + len(bins) // 50))}
    loose = [i for k in gone for i in bins[k]]
    return best_fit(loose, size, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(size: list[int], start: list[list[list[int]]], capacity: int, rng: Random, population: int, generations: int) -> list[list[int]]:
    """Best packing of one island after ``generations``; stops early at the least number of bins there can be."""
    least = max(-(-sum(size) // capacity), sum(2 * x > capacity for x in size))
    pool = [(fitness(b, size, capacity), b) for b in start]
    while len(pool) < population and not any(len(b) <= least for _, b in pool):
        items = list(range(len(size)))
        rng.shuffle(items)
        aside = len(items) // (1 + len(pool)) if pool else 0
        bins = best_fit(items[aside:], size, best_fit(items[:aside], size, [], capacity), capacity)
        pool.append((fitness(bins, size, capacity), bins))
    for _ in range(generations):
        pool.sort(key=lambda x: (len(x[1]), -x[0]))
        if len(pool[0][1]) <= least:
            break
        a, b = pool[0][1], pool[rng.randrange(1, len(pool))][1] if len(pool) > 1 else pool[0][1]
        child = mutate(crossover(a, b, size, capacity, rng), size, capacity, rng)
        pool[-1] = (fitness(child, size, capacity), child)
    return min(pool, key=lambda x: (len(x[1]), -x[0]))[1]


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)] if len(labels) else []


def _island(capacity: int, population: int, generations: int, seed: int):
    """Task of one island: evolves from its elite and the migrant, if it has them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.sort_values("source")
        block, island = int(key[0]), int(key[1])
        sizes = np.frombuffer(row["sizes"].iloc[0], "<i4")
        start = [_bins(np.frombuffer(x, "<i4")) for x in row["labels"] if x]
        best = evolve(sizes.tolist(), start, capacity, Random(seed * 1_000_003 + block * 101 + island), population, generations)
        return pd.DataFrame({"block": [block], "island": [island], "ids": [row["ids"].iloc[0]], "sizes": [row["sizes"].iloc[0]], "labels": [_labels(best, len(sizes)).astype("<i4").tobytes()], "n_bins": [len(best)], "fit": [fitness(best, sizes.tolist(), capacity)]})

    return run


_ISLAND = "block long, island int, ids binary, sizes binary, labels binary, n_bins int, fit double"


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("item")
    return pd.DataFrame({"block": [int(key[0])], "ids": [rows["item"].to_numpy("<i8").tobytes()], "sizes": [rows["length"].to_numpy("<i4").tobytes()]})


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items of each packed block: item, length, bin, offset, and the fill of the bin."""
    for batch in batches:
        for _, row in batch.iterrows():
            ids, sizes, labels = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("sizes", "<i4"), ("labels", "<i4")))
            order = np.argsort(labels, kind="stable")
            s, lab = sizes[order].astype(np.int64), labels[order]
            first = np.r_[True, lab[1:] != lab[:-1]]
            before = np.cumsum(s) - s
            offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(s)]))
            fill = np.bincount(labels, weights=sizes).astype(np.int64)[lab]
            yield pd.DataFrame({"block": np.int64(row["block"]), "item": ids[order], "length": s, "bin": lab.astype(np.int64), "offset": offset, "fill": fill})


def pack_items(items: DataFrame, capacity: int, block_items: int = 4096, islands: int = 2, rounds: int = 2, population: int = 6, generations: int = 12, seed: int = 7) -> DataFrame:
    """``items``: item long (unique), length long (1 to capacity - 1). Returns item, sequence_id, offset."""
    items = items.select("item", "length")

    def packed(items: DataFrame, blocks: int, level: int) -> DataFrame:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
        base = stored(dealt.groupBy("block").applyInPandas(_gather, "block long, ids binary, sizes binary"))
        every = F.array(*map(F.lit, range(islands)))
        state = base.select("block", F.explode(every).alias("island"), "ids", "sizes", F.lit(None).cast("binary").alias("labels"), F.lit(0).alias("source"))
        for r in range(rounds):
            best = state.repartition(max(1, blocks * islands), "block", "island").groupBy("block", "island").applyInPandas(_island(capacity, population, generations, seed + r), _ISLAND)
            best = stored(best)
            own = best.select("block", "island", "ids", "sizes", "labels", F.lit(0).alias("source"))
            moved = best.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "ids", "sizes", "labels", F.lit(1).alias("source"))
            state = own.unionByName(moved) if islands > 1 else own
        winner = best.groupBy("block").agg(F.min_by(F.struct("ids", "sizes", "labels"), F.struct("n_bins", -F.col("fit"), "island")).alias("w")).select("block", "w.*")
        return winner.mapInPandas(_place, "block long, item long, length long, bin long, offset long, fill long")

    n = items.count()
    blocks = max(1, -(-n // block_items))
    placed = stored(packed(items, blocks, 0))
    number = lambda level: (F.lit(level).cast("long") * (1 << 56) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id")
    out, level, before = None, 0, n
    while blocks > 1:
        loose = placed.where(F.col("fill") < capacity)
        left = loose.count()
        few = left <= LAST_BLOCKS * block_items
        if left == 0 or (level and not few and left > STALLED * before):
            break
        done = placed.where(F.col("fill") == capacity).select("item", number(level), "offset")
        out = done if out is None else out.unionByName(done)
        blocks, level, before = 1 if few else -(-left // block_items), level + 1, left
        placed = stored(packed(loose.select("item", "length"), blocks, level))
    last = placed.select("item", number(level), "offset")
    return last if out is None else out.unionByName(last)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, **parameters) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, path, pattern, capacity, end).withColumn("item", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    packed = rest.join(pack_items(rest, capacity, **parameters), "item")
    return full.unionByName(packed).drop("item")
