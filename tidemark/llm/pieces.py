"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that stands at a place, weighted by the piece's rank, and a
byte edge for every character that no piece spells. No piece of the vocabulary holds a space mark after another
character, so the lattice falls into segments, one per word with the spaces before it. Forward sums are computed once
per distinct segment; then all occurrences are sampled backwards together. The random numbers are a hash of the seed,
the row key, the place of the segment in its text and the place in the segment: the same row gives the same pieces on
any machine and in any batch.

Decoding is lossless: a space mark that the text itself holds is spelt in bytes.

Defined results: null text is empty and has no pieces; rows that repeat key and text get the same pieces; a null key is
a key of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, text_rows, tidy, worker_cache

MARK = "▁"
CACHE_SEGMENTS = 60_000
#: Stands for a space mark of the text itself, which no piece spells.
OWN_MARK = 0x110000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = re.compile(r" *[^ ]+| +$")


class Vocabulary:
    """Pieces, their log weights, and what each id decodes to. ``alpha`` sharpens the weights."""

    def __init__(self, path: str, alpha: float, offset: float = 50.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.weights: dict[str, tuple[float, int]] = {}
        self.spelling: list[bytes] = [b""] * self.size
        self.byte_ids = [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.spelling[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weights[piece] = (-alpha * math.log(offset - model.get_score(i)), i)
                self.spelling[i] = piece.replace(MARK, " ").encode()
        self.stretches = self._stretches()
        self.byte_weight = -alpha * math.log(offset + 2 * self.size)
        self.chars: dict[str, int] = {}
        self.char_bytes: list[list[int]] = []
        self.known = Lattices(self)

    def _stretches(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: hashes of all stretches that begin a piece, sorted, with the id (-1: none) and weight of a whole one."""
        by_length: list[dict[int, tuple[int, float]]] = [{} for _ in range(max(map(len, self.weights)))]
        for piece, (weight, i) in self.weights.items():
            hashed = 0
            for n, c in enumerate(mix(np.array(list(map(ord, piece)), np.uint64)).tolist()):
                hashed = (hashed * int(FACTOR) + c) % (1 << 64)
                by_length[n].setdefault(hashed, (-1, 0.0))
            by_length[len(piece) - 1][hashed] = (i, weight)
        out = []
        for stretches in by_length:
            keys = sorted(stretches)
            out.append((np.array(keys, np.uint64), np.array([stretches[k][0] for k in keys], np.int64), np.array([stretches[k][1] for k in keys], float)))
        return out

    def char(self, c: str) -> int:
        """A number over all ids that stands for the bytes of ``c`` until :meth:`spell_out`."""
        if c not in self.chars:
            self.chars[c] = self.size + len(self.char_bytes)
            self.char_bytes.append([self.byte_ids[b] for b in c.encode()])
        return self.chars[c]

    def spell_out(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stand-ins replaced by byte ids; ``ends``: where each text's ids end."""
        over = ids >= self.size
        if not over.any():
            return ids, ends
        width = np.ones(len(ids), np.int64)
        width[over] = [len(self.char_bytes[i - self.size]) for i in ids[over].tolist()]
        out = np.repeat(ids, width)
        out[np.repeat(over, width)] = np.concatenate([self.char_bytes[i - self.size] for i in ids[over].tolist()])
        total = np.r_[0, np.cumsum(width)]
        return out, total[ends]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))[1:]


class Lattices:
    """Forward-filtered segments. A row is a place at which edges end; its edges have cumulated probabilities.

    All new segments are filtered together: edges are found by rolling hashes of ever longer stretches that begin some
    piece, and the forward sums of equal places of all segments are taken at once.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.first, self.rows = vocabulary, {}, 0
        self.blocks: list[tuple[np.ndarray, ...]] = []

    def add(self, segments: list[str]) -> None:
        v = self.vocabulary
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        begins = np.cumsum(sizes) - sizes
        text = "".join(segments)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        code[code == ord(MARK)] = OWN_MARK
        code[code == ord(" ")] = ord(MARK)
        code = mix(code)
        stop = np.repeat(begins + sizes, sizes)
        at, hashed = np.arange(len(code)), np.zeros(len(code), np.uint64)
        ends, ids, lengths, weights = [], [], [], []
        single = np.zeros(len(code), bool)
        for length, (table, piece, weight) in enumerate(v.stretches, 1):
            inside = at + length <= stop[at]
            at, hashed = at[inside], hashed[inside]
            if not len(at):
                break
            hashed = hashed * FACTOR + code[at + length - 1]
            place = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
            begun = table[place] == hashed
            at, hashed, place = at[begun], hashed[begun], place[begun]
            whole = piece[place] >= 0
            if length == 1:
                single[at[whole]] = True
            ends.append(at[whole] + length - 1)
            ids.append(piece[place[whole]])
            weights.append(weight[place[whole]])
            lengths.append(np.full(len(ends[-1]), length))
        other = np.flatnonzero(~single).tolist()
        ends.append(np.array(other, np.int64))
        ids.append(np.array([v.char(text[i]) for i in other], np.int64))
        weights.append(np.array([v.byte_weight * len(text[i].encode()) for i in other], float))
        lengths.append(np.ones(len(other), np.int64))
        end, edge, length, weight = map(np.concatenate, (ends, ids, lengths, weights))
        order = np.lexsort((length, end))
        end, edge, length, weight = end[order], edge[order], length[order], weight[order]
        local = end - np.repeat(begins, sizes)[end]
        by_level = np.argsort(local, kind="stable")
        levels = np.searchsorted(local[by_level], np.arange(int(sizes.max(initial=0)) + 1))
        forward, cumulated = np.zeros(len(code)), np.empty(len(end))
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist()):
            own = by_level[lo:hi]
            row = end[own]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            count = np.diff(np.r_[first, len(row)])
            before = row - length[own]
            value = weight[own] + np.where(local[own] - length[own] >= 0, forward[before], 0.0)
            top = np.maximum.reduceat(value, first)
            part = np.exp(value - np.repeat(top, count))
            total = np.add.reduceat(part, first)
            forward[row[first]] = top + np.log(total)
            running = np.cumsum(part)
            share = (running - np.repeat(running[first] - part[first], count)) / np.repeat(total, count)
            share[np.r_[first[1:] - 1, len(row) - 1]] = 1.0
            cumulated[own] = share
        self.first.update(zip(segments, (begins + self.rows).tolist()))
        row_end = np.searchsorted(end, np.arange(len(code)), side="right")
        edges_before = sum(len(x[1]) for x in self.blocks)
        self.blocks.append((cumulated + end + self.rows, edge, length, row_end + edges_before))
        self.rows += len(code)

    def arrays(self):
        if len(self.blocks) > 1:
            self.blocks = [tuple(map(np.concatenate, zip(*self.blocks)))]
        return self.blocks[0]

    def sample(self, first: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence, from its end: (occurrence, step) -> id, as ids by occurrence and their number."""
        cumulated, edge_id, edge_length, row_end = self.arrays()
        at, left, step = np.arange(len(first)), length.copy(), 0
        steps = np.zeros(len(first), np.int64)
        taken = []
        while len(at):
            row = first[at] + left[at] - 1
            u = (mix(key[at] + left[at].astype(np.uint64)) >> np.uint64(11)) * 2.0**-53
            edge = np.minimum(np.searchsorted(cumulated, row + u, side="right"), row_end[row] - 1)
            taken.append((at, np.full(len(at), step), edge_id[edge]))
            left[at] -= edge_length[edge]
            steps[at] += 1
            at = at[left[at] > 0]
            step += 1
        begins = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for occurrence, step, ids in taken:
            out[begins[occurrence] + steps[occurrence] - 1 - step] = ids
        return out, steps


def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One vocabulary per Python worker, file and alpha."""
    kept = worker_cache("pieces")
    if (path, alpha) not in kept:
        kept[path, alpha] = Vocabulary(path, alpha)
    return kept[path, alpha]


def sample_texts(v: Vocabulary, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids begin and end (one more than texts)."""
    cut = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
    count = np.array([len(c) for c in cut], np.int64)
    segments = [s for c in cut for s in c]
    fresh = Lattices(v)
    if new := [s for s in dict.fromkeys(segments) if s not in v.known.first]:
        (v.known if len(v.known.first) < CACHE_SEGMENTS else fresh).add(new)
    ordinal = np.arange(len(segments)) - np.repeat(np.cumsum(count) - count, count)
    key = mix(np.repeat(np.array(keys, np.uint64), count) + mix(ordinal.astype(np.uint64)))
    length = np.fromiter(map(len, segments), np.int64, len(segments))
    known = np.fromiter(map(v.known.first.get, segments, [-1] * len(segments)), np.int64, len(segments))
    old = known >= 0
    steps = np.zeros(len(segments), np.int64)
    parts = []
    for which, lattice, first in ((old, v.known, known[old]), (~old, fresh, np.array([fresh.first[s] for s, o in zip(segments, old.tolist()) if not o], np.int64))):
        ids, n = lattice.sample(first, length[which], key[which]) if which.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        steps[which] = n
        parts.append(ids)
    out = np.empty(int(steps.sum()), np.int64)
    of_old = np.repeat(old, steps)
    out[of_old], out[~of_old] = parts
    ends = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), count), weights=steps, minlength=len(texts)).astype(np.int64))]
    return v.spell_out(out, ends)


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}")


def _encode(path: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = part.column("text").to_pylist()
                keys = [row_key(k, seed) for k in part.column("doc_id").to_pylist()]
                ids, ends = sample_texts(v, [t.decode("utf-8", "replace") for t in raw], keys)
                ids = ids.astype(np.int32)
                cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in cuts]
                every = list(map(v.spelling.__getitem__, ids.tolist()))
                same = [b"".join(every[a:b])[1:] == t for (a, b), t in zip(cuts, raw)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"],
                )

    return run


def encode_documents(docs: DataFrame, path: str, alpha: float = 0.5, seed: int = 11) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32, lossless (whether the ids decode to the text), ids."""
    id_type = dict(docs.dtypes)["doc_id"]
    return text_rows(docs, "doc_id").mapInArrow(tidy(_encode(path, alpha, seed)), f"doc_id {id_type}, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>")


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """``rows``: doc_id, ids. Returns doc_id, text."""
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, 1.0)
        for batch in batches:
            texts = [v.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")
