"""Removal of long byte strings that repeat anywhere in the corpus, by merged Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes is a *window*. Its *anchor* is the place in it of the 48-byte string with the least hash,
so equal windows have equal anchors, and the windows of one anchor are neighbours; together they span its *context*.
Three exact reductions come before any transform:

1. Anchors travel as two hashes, of the 48 bytes and of the context, to ranges of the hash space. An anchor found
   nowhere else has no window that repeats. A context found twice repeats whole, and only one copy of it goes on.
2. The other contexts, which share an anchor but differ somewhere, go as text to ranges by their anchor's hash. Where an
   anchor has more than ``HOT`` different contexts, each of its windows goes by its own hash, so no range is long.
3. In a range a window that holds a 50-byte block of weight one cannot repeat and is left out.

What remains is a text over 50-byte blocks: its strings run through the blocks at every fiftieth byte. Texts form shards
of bounded size; each shard's suffixes are sorted and give its transform (the block before each suffix). The transforms
are merged as a whole by refining their interleave: reading the blocks before the suffixes in the present interleave,
sorted stably, gives the interleave for prefixes one block longer. No suffix is compared with another one. A border that
first appears in round h says that the common prefix there has h - 1 blocks; after four rounds the places without a
border are the repeated intervals of 200 bytes, and every suffix in one is the start of a repeated window.

Texts form chunks that are scanned again when they are needed (by Spark's own exchange where it can reuse it); nothing
is gathered on the driver but the length of the corpus. Chunks number rows by partition and place, so the input should
be a table scan, or one whose partitions come back the same after an executor is lost.

Defined results: null text is empty; a text shorter than ``LENGTH`` keeps all; rows that repeat a text, or a doc_id, are
rows of their own (equal texts of that length lose everything); matches do not cross rows; an empty table gives an empty
result; a null doc_id stays null. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, text_rows, tidy
from tidemark.llm.corpus_counts import ROW, long_names, range_bits, row_batch, runs, squeezed, to_bytes, unsqueezed

LENGTH, ANCHOR, BLOCK = 200, 48, 50
ROUNDS = LENGTH // BLOCK
CHUNK_DOCS, CHUNK_BYTES, PIECE = 8192, 6_000_000, 1 << 17
HOT = 256
#: Characters of the corpus for one range of texts, suffixes of a shard, and positions merged at once.
RANGE_CHARS, SHARD, MERGE = 8_000_000, 1 << 17, 1 << 21
#: A context's state: found more than once, sent to be compared, one of more than HOT.
TWICE, SENT, MANY = 1, 2, 4

_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = int(mix(np.array([77], np.uint64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place of ``data`` on."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    if len(_POWERS.get("up", ())) < len(data):
        n = 1 << int(len(data) - 1).bit_length()
        _POWERS.update(up=_powers(_BASE, n), down=_powers(_INVERSE, n))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _POWERS["up"][: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _POWERS["down"][: len(data) - size + 1])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by windows of doubled length."""
    span = 1
    n = len(x) - size + 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[size - span : size - span + n])


class Anchors:
    """Anchors of some texts laid end to end: ``name`` (hash of the anchor), ``first`` and ``last`` window."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        name, first, last = [], [], []
        end_of = np.repeat(ends, np.diff(np.r_[0, ends]))
        for lo, hi in pieces(np.r_[0, ends].tolist()):
            part = data[lo:hi]
            hashes = rolling(part, ANCHOR)
            if len(part) < LENGTH:
                continue
            # ordered by hash, the leftmost of equals: the place fills the low bits
            key = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
            at = sliding_least(key, LENGTH - ANCHOR + 1).astype(np.int64) & 0xFFFFFF
            window = np.arange(len(at))
            inside = np.flatnonzero(lo + window + LENGTH <= end_of[lo : lo + len(at)])
            begins, count = runs(at[inside])
            name.append(mix(hashes[at[inside[begins]]] ^ np.uint64(0x5DEECE66D)))
            first.append(lo + inside[begins])
            last.append(lo + inside[begins + count - 1])
        empty = [np.zeros(0, np.int64)]
        self.name = np.concatenate(name or [np.zeros(0, np.uint64)])
        self.first, self.last = np.concatenate(first or empty), np.concatenate(last or empty)
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(view[a:b]) for a, b in zip(self.first.tolist(), (self.last + LENGTH).tolist())), np.uint64, len(self.first))
        # contexts in order of name and text, each once
        order = np.lexsort((context, self.name))
        new = np.r_[True, (np.diff(self.name[order]) != 0) | (np.diff(context[order]) != 0)] if len(order) else np.zeros(0, bool)
        self.one = order[new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.place, minlength=len(self.one))
        self.context = context


def pieces(cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of whole texts; a text longer than a piece comes in parts that share LENGTH - 1 bytes."""
    lo = cuts[0]
    for a, b in zip(cuts, cuts[1:]):
        if b - lo > PIECE and a > lo:
            yield lo, a
            lo = a
        while b - lo > PIECE:
            yield lo, lo + PIECE
            lo += PIECE - LENGTH + 1
    if cuts[-1] > lo:
        yield lo, cuts[-1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """Partition and place as one number, ids and texts of each chunk."""
    ids, texts, size, number = [], [], 0, 0
    for batch in batches:
        for part, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            number = number or part << 32
            texts.append(text.as_py())
            ids.append(doc_id)
            size += len(texts[-1])
            if len(ids) >= CHUNK_DOCS or size > CHUNK_BYTES:
                yield number, ids, texts
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield number, ids, texts


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _anchor_rows(bits: int):
    """To each range its contexts of a chunk: names, context hashes, and which of them the chunk holds twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _chunks(batches):
            a = Anchors(*_laid(texts))
            name, context, twice = a.name[a.one], a.context[a.one], (a.count > 1).astype("u1")
            first, size = runs(name >> np.uint64(64 - bits))
            names = long_names(name, bits)
            rows = [(int(name[i]) >> (64 - bits), number, to_bytes(names[i : i + n]), context[i : i + n].tobytes(), twice[i : i + n].tobytes(), b"") for i, n in zip(first.tolist(), size.tolist())]
            for lo in range(0, len(rows), 4096):
                yield row_batch(rows[lo : lo + 4096])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its ids, the lengths of its texts, and the texts."""
    for number, ids, texts in _chunks(batches):
        flags = np.array([i is None for i in ids], "u1").tobytes()
        yield row_batch([(-1, number, flags, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(b"".join(texts), 1))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([row_batch(rows)]) if rows else pa.Table.from_batches([], row_batch([(0, 0, b"", b"", b"", b"")]).schema)


def _six(data: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(data), "u1").reshape(-1, 6)
    out = np.zeros((len(six), 8), "u1")
    out[:, :6] = six
    return out.view("<u8").ravel()


def _states(key: tuple, rows: pa.Table) -> pa.Table:
    """One range of anchors: the state of each context, for the chunk that holds it."""
    name, context = _six(rows["a"].to_pylist()), np.frombuffer(b"".join(rows["b"].to_pylist()), "<u8")
    twice = np.frombuffer(b"".join(rows["c"].to_pylist()), "u1")
    size = [len(x) for x in rows["c"].to_pylist()]
    chunk = np.repeat(rows["chunk"].to_numpy(), size)
    order = np.lexsort((chunk, context, name))
    n, c = name[order], context[order]
    new_name = np.r_[True, n[1:] != n[:-1]]
    new = new_name | np.r_[True, c[1:] != c[:-1]]
    group, whole = np.cumsum(new) - 1, np.cumsum(new_name) - 1
    found = np.bincount(group, weights=1 + twice[order])[group] > 1
    contexts = np.bincount(whole[new])[whole]
    state = np.where(found, TWICE, 0) | np.where(contexts > HOT, MANY, 0)
    # of a context found twice, the first chunk sends one copy, and only where there are others to compare it with
    state = np.where((contexts > 1) & (~found | new), state | SENT, state).astype("u1")
    back = np.empty(len(state), "u1")
    back[order] = state
    ends = np.cumsum(size)
    return _table([(key[0].as_py(), k, back[e - s : e].tobytes(), b"", b"", b"") for k, s, e in zip(rows["chunk"].to_pylist(), size, ends)])


def _unpacked(head: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(head["c"][0].as_py(), "<i8")
    return np.frombuffer(zstandard.decompress(head["d"][0].as_py(), max_output_size=int(sizes.sum()) or 1), np.uint8), np.cumsum(sizes)


def _texts(bits: int):
    """One chunk: the windows known to repeat, and to each range the texts to compare.

    The chunk's own row keeps where windows repeat (first, number), and of each text sent its range, place and windows.
    A range's row has the texts, their lengths, and a byte for each: the top bit says that it is known to repeat, the
    others deal texts within the range.
    """

    def run(key: tuple, answers: pa.Table, head: pa.Table) -> pa.Table:
        number = key[0].as_py()
        data, ends = _unpacked(head)
        a = Anchors(data, ends)
        answers = answers.sort_by("key")
        state = np.frombuffer(b"".join(answers["a"].to_pylist()), "u1")
        count = a.last - a.first + 1
        known = np.flatnonzero((state & TWICE)[a.place] > 0) if len(state) else np.zeros(0, np.int64)
        spans = [(a.first[known], count[known])]
        sent = a.one[(state & SENT) > 0]
        hot = (state[a.place[sent]] & MANY) > 0
        cold, many = sent[~hot], sent[hot]
        route, start, n = [a.name[cold]], [a.first[cold]], [count[cold]]
        weight = [state[a.place[cold]] & TWICE]
        if len(many):
            window = np.concatenate([np.arange(x, y + 1) for x, y in zip(a.first[many].tolist(), a.last[many].tolist())])
            sure = np.repeat(state[a.place[many]] & TWICE, count[many])
            name = np.concatenate([_window_names(data, x, y) for x, y in zip(a.first[many].tolist(), a.last[many].tolist())])
            distinct, at, inverse, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            sure = (np.bincount(inverse, weights=sure) > 0) | (times > 1)
            spans.append((window[sure[inverse]], np.ones(int(sure[inverse].sum()), np.int64)))
            route.append(distinct)
            start.append(window[at])
            n.append(np.ones(len(at), np.int64))
            weight.append(sure.astype("u1"))
        route, start, n, weight = map(np.concatenate, (route, start, n, weight))
        order = np.argsort(route, kind="stable")
        route, start, n, weight = route[order], start[order], n[order], weight[order]
        deal = ((route >> np.uint64(57 - bits)) & np.uint64(127)).astype("u1") | (weight.astype("u1") << 7)
        ranges = (route >> np.uint64(64 - bits)).astype(np.int64)
        first, size = runs(ranges)
        known_first, known_count = (np.concatenate(x).astype("<i4") for x in zip(*spans))
        own = (squeezed(known_first), squeezed(known_count), squeezed(start.astype("<i4")), squeezed(n.astype("<i4")))
        rows = [(-1 - number, number, *own)]
        view = memoryview(data)
        for i, m in zip(first.tolist(), size.tolist()):
            text = b"".join(view[s : s + w + LENGTH - 1] for s, w in zip(start[i : i + m].tolist(), n[i : i + m].tolist()))
            rows.append((int(ranges[i]), number, zstandard.compress(text, 1), squeezed(n[i : i + m].astype("<i4")), deal[i : i + m].tobytes(), b""))
        return _table(rows)

    return run


def _window_names(data: np.ndarray, first: int, last: int) -> np.ndarray:
    return rolling(data[first : last + LENGTH], LENGTH)


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to 2^32, by their two halves: numpy sorts 16 bits by radix."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x[low] >> 16).astype(np.uint16), kind="stable")] if len(x) and x.max() >> 16 else low


def transform(symbol: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of the strings of one shard.

    ``symbol`` of each place, the place ``before`` it in its string (-1 at its start), the last place of each string.
    Suffixes are numbered by place; the empty suffix of string j is len(symbol) + j and sorts first, in that order.
    """
    nothing = np.arange(len(symbol), len(symbol) + len(ends))
    previous = np.r_[before, ends]
    order = np.arange(len(symbol))
    while True:
        reached = previous[np.r_[nothing, order]]
        reached = reached[reached >= 0]
        longer = reached[stable_order(symbol[reached])]
        if np.array_equal(longer, order):
            return np.r_[nothing, order]
        order = longer


def merge(transforms: list[np.ndarray], strings: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms for prefixes of ``rounds`` symbols.

    A transform holds the symbol before each suffix, 0 where there is none; ``strings`` their number in each shard.
    Returned: each place's suffix (its place in the transforms laid end to end), the length of the prefix it shares
    with the place before (``rounds`` at most), and the number of the interval of equal prefixes that it lies in.
    """
    size = [len(t) for t in transforms]
    laid = np.concatenate(transforms)
    interleave = np.repeat(np.arange(len(size)), size)
    empty = np.repeat(np.arange(len(size)), strings)
    interval, shared = np.zeros(len(laid), np.int64), np.full(len(laid), rounds)
    for h in range(rounds):
        preceding = np.empty_like(laid)
        preceding[stable_order(interleave)] = laid
        some = np.flatnonzero(preceding)
        longer = some[stable_order(preceding[some])]
        p, i = preceding[longer], interval[longer]
        border = np.r_[np.ones(len(empty), bool), np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1])][: len(p)]]
        shared[border & (shared == rounds)] = h
        interleave = np.r_[empty, interleave[longer]]
        interval = np.cumsum(border) - 1
    suffix = np.empty(len(laid), np.int64)
    suffix[stable_order(interleave)] = np.arange(len(laid))
    return suffix, shared, interval


def repeated(data: np.ndarray, windows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether each window repeats, for texts laid end to end: ``windows`` of each text and the weight of each of them."""
    sizes = windows + LENGTH - 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    is_window = np.zeros(len(data) + LENGTH, bool)
    starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    is_window[starts] = True
    out = np.zeros(len(data), bool)

    def covered(mask: np.ndarray) -> np.ndarray:
        """Places of the blocks of the windows in ``mask``."""
        blocks = mask.copy()
        for k in range(1, ROUNDS):
            blocks[k * BLOCK :] |= mask[: len(mask) - k * BLOCK]
        return blocks

    # blocks of weight one end the windows that hold them
    place = np.flatnonzero(covered(is_window))
    name, symbol = np.unique(rolling(data, BLOCK)[place], return_inverse=True)
    heavy = np.bincount(symbol, weights=np.repeat(weight, sizes)[place], minlength=len(name)) > 1
    good = np.zeros(len(is_window), bool)
    good[place] = heavy[symbol]
    left = is_window.copy()
    for k in range(ROUNDS):
        left[: len(left) - k * BLOCK] &= good[k * BLOCK :]
    kept = covered(left)
    node = np.flatnonzero(kept)
    if not len(node):
        return out[starts]
    number = np.full(len(kept), -1, np.int64)
    number[node] = np.arange(len(node))
    symbol = symbol[np.searchsorted(place, node)] + 1
    text = np.searchsorted(ends, node, "right")
    back = np.where(node - BLOCK >= begins[text], number[node - BLOCK], -1)
    last = np.ones(len(node), bool)
    last[back[back >= 0]] = False
    # shards of whole texts
    shard = (np.cumsum(np.bincount(text, minlength=len(sizes))) // SHARD)[text]
    first, count = runs(shard)
    transforms, orders, strings = [], [], []
    for a, n in zip(first.tolist(), count.tolist()):
        ending = np.flatnonzero(last[a : a + n])
        before = np.where(back[a : a + n] >= 0, back[a : a + n] - a, -1)
        order = transform(symbol[a : a + n], before, ending)
        previous = np.r_[before, ending][order]
        transforms.append(np.where(previous >= 0, symbol[a : a + n][previous], 0))
        orders.append(np.where(order < n, order + a, -1))
        strings.append(len(ending))
    suffix, shared, interval = merge(transforms, strings, ROUNDS)
    at = np.concatenate(orders)[suffix]
    heavier = np.bincount(interval, weights=np.where(at >= 0, weight[text[at]], 0))
    # an interval of 200 bytes, or one suffix whose text is known to repeat
    inside = (at >= 0) & (heavier[interval] > 1)
    out[node[at[inside]]] = True
    return out[starts] & left[starts]


def _compared(key: tuple, rows: pa.Table) -> pa.Table:
    """One range of texts: a bit for each window of each chunk's texts. Rows of chunks pass as they are."""
    if key[0].as_py() < 0:
        return rows
    texts = [zstandard.decompress(x) for x in rows["a"].to_pylist()]
    windows = [unsqueezed(x, "<i4").astype(np.int64) for x in rows["b"].to_pylist()]
    deal = np.concatenate([np.frombuffer(x, "u1") for x in rows["c"].to_pylist()])
    every = np.concatenate(windows)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = every + LENGTH - 1
    begins, at = np.cumsum(sizes) - sizes, np.cumsum(every) - every
    flags = np.zeros(int(every.sum()), bool)
    dealt = deal & 127
    load = np.cumsum(np.bincount(dealt, weights=sizes, minlength=128))
    group = (load // MERGE).astype(np.int64)[dealt]
    for g in np.unique(group).tolist():
        t = np.flatnonzero(group == g)
        if len(t) > 1:
            part = np.concatenate([data[a : a + s] for a, s in zip(begins[t].tolist(), sizes[t].tolist())])
            got = repeated(part, every[t], 1 + (deal[t] >> 7).astype(np.int64))
            flags[np.repeat(at[t] - (np.cumsum(every[t]) - every[t]), every[t]) + np.arange(len(got))] = got
        elif len(t) == 1:
            a, s, w = begins[t[0]], sizes[t[0]], every[t[0]]
            flags[at[t[0]] : at[t[0]] + w] = repeated(data[a : a + s], every[t], 1 + (deal[t] >> 7).astype(np.int64))
    cuts = np.r_[0, np.cumsum([w.sum() for w in windows])].astype(int).tolist()
    return _table([(key[0].as_py(), c, np.packbits(flags[a:b]).tobytes(), (b - a).to_bytes(8, "little"), b"", b"") for c, a, b in zip(rows["chunk"].to_pylist(), cuts, cuts[1:])])


RESULT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _removed(key: tuple, answers: pa.Table, head: pa.Table) -> pa.Table:
    """Rows of one chunk: what is removed of each text, and what is left."""
    data, ends = _unpacked(head)
    answers = answers.sort_by("key")
    own = answers.slice(0, 1)
    first, count, start, n = (unsqueezed(own[c][0].as_py(), "<i4").astype(np.int64) for c in "abcd")
    # texts went out in order of range, and the bits come back in that order
    bits = zip(answers["a"].to_pylist()[1:], answers["b"].to_pylist()[1:])
    flags = [np.unpackbits(np.frombuffer(x, "u1"), count=int.from_bytes(n, "little")) for x, n in bits]
    flag = np.concatenate(flags or [np.zeros(0, "u1")]).astype(bool)
    window = (np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()))[flag]
    size = len(data) + LENGTH + 1
    step = np.bincount(first, minlength=size) - np.bincount(first + count - 1 + LENGTH, minlength=size)
    step += np.bincount(window, minlength=size) - np.bincount(window + LENGTH, minlength=size)
    gone = np.cumsum(step[: len(data)]) > 0
    return _documents(data, ends, gone, head)


def _documents(data: np.ndarray, ends: np.ndarray, gone: np.ndarray, head: pa.Table) -> pa.Table:
    sizes = np.diff(np.r_[0, ends])
    null = np.frombuffer(head["a"][0].as_py(), "u1") != 0
    ids = np.frombuffer(head["b"][0].as_py(), "<i8")
    starts, stops, kept = [], [], []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
        starts.append(edge[::2].tolist())
        stops.append(edge[1::2].tolist())
        kept.append(data[a:b][~gone[a:b]].tobytes())
    longs = pa.list_(pa.int64())
    return pa.table({"doc_id": pa.array(ids, mask=null), "n_bytes": pa.array(sizes), "starts": pa.array(starts, longs), "ends": pa.array(stops, longs), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans removed (bytes, end exclusive), and the bytes kept."""
    rows = text_rows(docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "part", "doc_id")
    anchor_bits = range_bits(docs, chars_per_key=(LENGTH - ANCHOR) / 2)
    text_bits = range_bits(docs, RANGE_CHARS, 1.0)
    heads = rows.mapInArrow(tidy(_heads), ROW).groupBy("chunk")
    states = rows.mapInArrow(tidy(_anchor_rows(anchor_bits)), ROW).groupBy("key").applyInArrow(_states, ROW)
    texts = states.groupBy("chunk").cogroup(heads).applyInArrow(_texts(text_bits), ROW)
    compared = texts.groupBy("key").applyInArrow(_compared, ROW)
    out = compared.groupBy("chunk").cogroup(heads).applyInArrow(_removed, RESULT)
    return out.select("doc_id", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept")


def removal_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, and the digest of the bytes kept."""
    removed = F.col("n_bytes") - F.length("kept")
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
