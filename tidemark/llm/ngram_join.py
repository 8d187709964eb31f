"""N-gram Jaccard self-join of documents, by rare-first prefix filtering.

A document's set holds its distinct word n-grams. Sets that are equal are one class. N-grams are ordered by the number
of documents that hold them, rarest first, then by hash; two sets similar enough share an n-gram among the first few
of each (the prefix). N-grams of one document are shared with none: they only fill up the prefix. Candidate pairs meet
on a prefix n-gram, pass a length and a positional filter, are made distinct, pass a suffix filter, and are verified
once by their exact overlap.

Only components are asked for, so a pair inside one component needs no verification. First each class is compared with
the hub that shares most of its prefix n-grams and one more, a hub being one member of an n-gram's list. Then every list
whose classes are still in different components is searched for pairs, in blocks of a task's size: a pair that can be
similar shares not one but several prefix n-grams (the prefix is longer than the pair's sizes ask for), and bitmaps of
the prefixes bound how many it shares, so that lists of near copies that miss the threshold do not come out as rows.
Some rounds take only each member's pairs that share most, as these most likely join components; the last takes all.

Defined results: a text with fewer words than n has its whole word sequence as one n-gram; without words, or for a null
text, the set is empty and the document is linked with nothing; rows that repeat a doc_id are each in the result; a
null doc_id is a component of its own with a null component_id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, stored, text_rows, tidy, worker_cache
from tidemark.llm.components import components
from tidemark.llm.corpus_counts import CHUNK_DOCS, CHUNK_KEYS, ROW, chunk_rows, from_bytes, full, range_bits, runs, to_bytes

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; words are split and lower-cased as ASCII."""
    known, codes = worker_cache("ngram"), []
    for w in text.lower().split():
        c = known.get(w)
        if c is None:
            c = xxhash.xxh3_64_intdigest(w)
            if len(known) < 100_000:
                known[w] = c
        codes.append(c)
    if not codes:
        return np.zeros(0, np.uint64)
    w = np.array(codes, np.uint64)
    size = min(n, len(w))
    total = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        total += w[k : len(w) - size + 1 + k] * _FACTORS[k]
    out = np.sort(mix(total + np.uint64(size)))
    return out[np.r_[True, out[1:] != out[:-1]]]


def _scatter(n: int, bits: int):
    """Chunks of documents: their keys by range, and what the chunk needs again under its own key."""

    def emit(chunk: int, ids: list, sets: list[np.ndarray]):
        head = np.array([len(s) for s in sets], "<i4").tobytes() + b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
        return chunk_rows(chunk, np.array(ids, "<i8").tobytes(), head, sets, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, ids, sets, size = (context.partitionId() if context else 0) << 24, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), n))
                size += len(sets[-1])
                if len(ids) == CHUNK_DOCS or size > CHUNK_KEYS:
                    yield emit(chunk, ids, sets)
                    chunk, ids, sets, size = chunk + 1, [], [], 0
        if ids:
            yield emit(chunk, ids, sets)

    return run


def rarity(count: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact below 128, in eighths of an octave above."""
    return np.where(count < 128, count, np.minimum(128 + 8 * np.log2(np.maximum(count, 128) / 128), 255)).astype("u1")


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One range: documents per key over all chunks; keys of one document are left out of the answers."""
    if key[0] < 0:
        return rows
    rows = rows.sort_values("chunk")
    names, heavy = [from_bytes(x) for x in rows["a"]], [from_bytes(x) for x in rows["c"]]
    every = np.concatenate(names + heavy)
    weight = np.concatenate([np.ones(sum(map(len, names))), *[np.frombuffer(x, "<u4") for x in rows["d"]]])
    order = np.argsort(every, kind="stable")
    first, length = runs(every[order])
    total = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
    count = np.empty(len(every))
    count[order] = np.repeat(total, length)
    out, at, h = [], 0, sum(map(len, names))
    for chunk, name, doc, big in zip(rows["chunk"], names, rows["b"], heavy):
        own, own_heavy = count[at : at + len(name)], count[h : h + len(big)]
        at, h = at + len(name), h + len(big)
        kept = own >= 2
        if kept.any() or len(big):
            out.append((key[0], chunk, to_bytes(name[kept]), np.frombuffer(doc, "<u2")[kept].tobytes() + rarity(own[kept]).tobytes(), to_bytes(big), rarity(own_heavy).tobytes()))
    return pd.DataFrame(out, columns=["key", "chunk", "a", "b", "c", "d"])


_SET = "row long, doc_id long, n int, sig binary, ids binary, prefix array<long>"


def _sets(percent: int, bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One chunk: each document's shared keys, rarest first, and those of them that lie in its prefix."""
        rows = rows.sort_values("key")
        head, answers = rows.iloc[0], rows.iloc[1:]
        ids = np.frombuffer(head["a"], "<i8")
        sizes = np.frombuffer(head["b"][: 4 * len(ids)], "<i4")
        sigs = head["b"][4 * len(ids) :]
        keys, docs, codes, big, big_codes = [], [], [], [], []
        for r, a, b, c, d in zip(answers["key"], answers["a"], answers["b"], answers["c"], answers["d"]):
            name = from_bytes(a)
            keys.append(full(r, name, bits))
            docs.append(np.frombuffer(b[: 2 * len(name)], "<u2"))
            codes.append(np.frombuffer(b[2 * len(name) :], "u1"))
            big.append(full(r, from_bytes(c), bits))
            big_codes.append(np.frombuffer(d, "u1"))
        counts = np.frombuffer(head["c"], "<u4")
        none = [np.zeros(0, np.uint64)]
        keys = np.concatenate(none + keys + [np.repeat(np.concatenate(none + big), counts)])
        docs = np.concatenate([np.zeros(0, np.int64), *docs, np.frombuffer(head["d"], "<u2")]).astype(np.int64)
        codes = np.concatenate([np.zeros(0, "u1"), *codes, np.repeat(np.concatenate([np.zeros(0, "u1"), *big_codes]), counts)])
        order = np.lexsort((keys, codes, docs))
        keys, docs = keys[order].astype("<i8"), docs[order]
        ends = np.searchsorted(docs, np.arange(len(ids) + 1))
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            size = int(sizes[i])
            reach = size - -(-percent * size // 100) + 1 - (size - (b - a))
            out.append(((int(key[0]) << 16) + i, ids[i], size, sigs[16 * i : 16 * i + 16], keys[a:b].tobytes(), keys[a : a + max(0, min(reach, b - a))] if size else keys[:0]))
        return pd.DataFrame(out, columns=["row", "doc_id", "n", "sig", "ids", "prefix"])

    return run


def _overlaps(percent: int):
    """Rows of verified pairs: the suffix filter bounds the overlap by 16 parts of the key space before it is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q, m, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids_x", "ids_y", "n_x", "n_y")))):
                x, y = np.sort(np.frombuffer(p, "<i8")), np.sort(np.frombuffer(q, "<i8"))
                need = -(-percent * (m + n) // (100 + percent))
                if min(len(x), len(y)) < need:
                    continue
                lo, hi = int(min(x[0], y[0])), int(max(x[-1], y[-1]))
                parts = np.array([lo + (hi - lo) * k // 16 for k in range(1, 16)], np.int64)
                bound = np.minimum(*(np.diff(np.r_[0, np.searchsorted(z, parts), len(z)]) for z in (x, y))).sum()
                if bound < need:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (m + n - same)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep))

    return run


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: row, doc_id, n (size of its set), sig (digest of the set), ids (shared keys, rarest first), prefix."""
    bits = range_bits(docs)
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = text_rows(own, "doc_id").mapInArrow(tidy(_scatter(n, bits)), ROW)
    counted = rows.groupBy("key").applyInPandas(_count, ROW)
    return counted.groupBy("chunk").applyInPandas(_sets(percent, bits), _SET)


def needed(m, n, percent: int):
    """Overlap that two sets of these sizes need."""
    return F.ceil(percent * (m + n) / F.lit(100 + percent))


def similar(m, n, i, j, percent: int):
    """Length and positional filter: with a shared n-gram at places i and j, can the overlap suffice?"""
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (F.least(i, j) + 1 + F.least(m - i - 1, n - j - 1) >= needed(m, n, percent))


BITS, BLOCK, BUNDLE = 1024, 512, 20_000


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the shared n-grams in each prefix, and by how many the bits fall short of the n-grams."""
    for batch in batches:
        maps, lost = [], []
        for keys in batch.column("prefix").to_pylist():
            bits = np.zeros(BITS, bool)
            bits[mix(np.array(keys, np.int64).view(np.uint64)) % np.uint64(BITS)] = True
            maps.append(np.packbits(bits).tobytes())
            lost.append(len(keys) - int(bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(maps, pa.binary()), pa.array(lost, pa.int32())], names=["x", "bits", "lost"])


def _search(percent: int, best: int | None = None):
    """Pairs of one list, or of two blocks of it, in different components that pass all filters on sizes and prefixes.

    The first size - needed + k n-grams of two similar sets share k; so their prefixes, of the length size -
    ceil(percent size / 100) + 1, share at least needed + 1 less the greater of those ceilings, and one of the shared
    n-grams lies in the first size - needed + 1 of both. With ``best``, a member keeps that many of its pairs, those that
    share most.
    """

    def pairs(part: pd.DataFrame, crossed: bool):
        x, n, at, component, lost, block = (part[c].to_numpy() for c in ("x", "n_x", "at_x", "component", "lost", "block"))
        bits = np.frombuffer(b"".join(part["bits"]), "<u8").reshape(len(part), -1)
        m, k = n[:, None].astype(np.int64), n[None, :].astype(np.int64)
        need = -(-percent * (m + k) // (100 + percent))
        fits = (x[:, None] < x[None, :]) if not crossed else (block[:, None] < block[None, :])
        fits = fits & (component[:, None] != component[None, :]) & (100 * np.minimum(m, k) >= percent * np.maximum(m, k))
        i, j = at[:, None].astype(np.int64), at[None, :].astype(np.int64)
        fits &= (i <= m - need) & (j <= k - need)
        a, b = np.nonzero(fits)
        least = lambda size: -(-percent * size.astype(np.int64) // 100)
        ask = need[a, b] + 1 - np.maximum(least(n[a]), least(n[b]))
        share = np.zeros(len(a), np.int64)
        for w in range(bits.shape[1]):
            share += np.bitwise_count(bits[a, w] & bits[b, w])
        kept = share + np.minimum(lost[a], lost[b]) >= ask
        a, b, share = a[kept], b[kept], share[kept]
        if best and len(a):
            keep = np.zeros(len(a), bool)
            for side in (a, b):
                order = np.lexsort((-share, side))
                first, length = runs(side[order])
                place = np.arange(len(order)) - np.repeat(first, length)
                keep[order[place < best]] = True
            a, b = a[keep], b[keep]
        return np.minimum(x[a], x[b]), np.maximum(x[a], x[b])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pairs(part, i != j) for (_, i, j), part in rows.groupby(["key", "i", "j"], sort=False)]
        x, y = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"x": x, "y": y}).drop_duplicates()

    return run


def join_documents(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 2) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; documents link at a Jaccard similarity of ``percent`` / 100."""
    sets = stored(shingle_sets(docs, n, percent))
    classes = stored(sets.where("n > 0").groupBy("sig").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")))
    own = stored(sets.where(F.size("prefix") > 0).join(classes.select("sig", "row"), ["sig", "row"]).select("row", "n", "ids", "prefix"))
    bodies = own.select("row", "n", "ids")
    every = own.select("row", "n", (F.col("n") - (F.length("ids") / 8).cast("int")).alias("first"), F.posexplode("prefix").alias("at", "key")).select("key", F.col("row").alias("x"), F.col("n").alias("n_x"), (F.col("first") + F.col("at")).alias("at_x"))
    lists = stored(every.groupBy("key").agg(F.count("*").alias("length")).where("length > 1").select("key"))
    posts = stored(every.join(lists, "key", "left_semi"))
    groups = None

    def open_lists():
        """Members, with their components, of lists whose members are in more than one."""
        if groups is None:
            return posts.withColumn("component", F.col("x"))
        known = posts.join(groups.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        known = stored(known)
        mixed = stored(known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"))
        return stored(known.join(mixed, "key", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = bodies.select(F.col("row").alias("x"), F.col("n").alias("n_x"), F.col("ids").alias("ids_x"))
        right = bodies.select(F.col("row").alias("y"), F.col("n").alias("n_y"), F.col("ids").alias("ids_y"))
        return stored(pairs.join(left, "x").join(right, "y").select("x", "y", "n_x", "n_y", "ids_x", "ids_y").mapInArrow(tidy(_overlaps(percent)), "a long, b long"))

    members = open_lists()
    hub = F.min_by(F.struct(F.col("x").alias("y"), F.col("n_x").alias("n_y"), F.col("at_x").alias("at_y")), F.xxhash64("x"))
    hubs = stored(members.groupBy("key").agg(hub.alias("hub")).select("key", "hub.*"))
    near = members.join(hubs, "key").where((F.col("x") != F.col("y")) & similar(F.col("n_x"), F.col("n_y"), F.col("at_x"), F.col("at_y"), percent))
    best = near.groupBy("x", "y").agg(F.count("*").alias("c")).groupBy("x").agg(F.max_by("y", F.struct("c", "y")).alias("p"), F.max_by("y", F.struct(F.xxhash64("x", "y"), "y")).alias("q"))
    tried = stored(best.select("x", F.explode(F.array("p", "q")).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    links = verified(tried)
    groups = components(links)
    bitmaps = stored(own.select("row", "prefix").mapInArrow(tidy(_bitmaps), "x long, bits binary, lost int"))

    def searched(best: int | None) -> DataFrame:
        """New pairs of the lists that are still open, ``best`` for each member and list or all."""
        members = open_lists()
        sized = stored(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("length")))
        rows = sized.agg(F.sum(F.col("blocks") * F.col("length"))).first()[0] or 0
        cut = members.join(bitmaps, "x").join(sized.drop("length"), "key").withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int"))
        dealt = cut.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "x", "n_x", "at_x", "component", "bits", "lost", "block")
        bundle = F.pmod(F.xxhash64("key", "i", "j"), F.lit(int(rows) // BUNDLE + 1))
        return dealt.withColumn("bundle", bundle).groupBy("bundle").applyInPandas(_search(percent, best), "x long, y long").distinct().join(tried, ["x", "y"], "left_anti")

    for _ in range(rounds):
        pairs = stored(searched(2))
        tried = tried.unionByName(pairs)
        links = links.unionByName(verified(pairs))
        groups = components(links)
    groups = components(links.unionByName(verified(searched(None))))

    rooted = stored(classes.join(groups.withColumnsRenamed({"node": "row"}), "row", "left").select("sig", "least", F.coalesce("component", "row").alias("component")))
    least = stored(rooted.groupBy("component").agg(F.min("least").alias("component_id")))
    named = stored(rooted.join(least, "component").select("sig", "component_id"))
    result = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(named, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = text_rows(docs.where(F.col("doc_id").isNull())).mapInArrow(_sizes(n), "n_shingles long")
    return result.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t.as_py(), n)) for t in batch.column("text")], pa.int64())], names=["n_shingles"])

    return run


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, that of the smallest doc_id; rows that repeat doc_id and text become one.

    Documents without words, and those with a null doc_id, stay.
    """
    found = stored(join_documents(docs, n, percent).where(F.col("doc_id").isNotNull()))
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stored(dropped), "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(found.where(F.col("n_shingles") > 0).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
