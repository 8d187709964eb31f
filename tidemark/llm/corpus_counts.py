"""How often each key occurs in the corpus, brought back to the documents that hold it, in compact column blocks.

A scan of the documents makes *chunks* of some thousand documents. The keys (64-bit hashes) of a chunk are sorted and
dealt into ranges by their highest bits; a range holds the same keys of all chunks, counts them, and answers each
chunk. A key that many documents of a chunk share travels once with its count, so that a passage found everywhere does
not make one range long. What a chunk needs besides (its documents) waits under a key of the chunk's own.

Row layout between the steps: key long (range, or -1 - chunk), chunk long, a, b, c, d binary.
Inside a range a key is named by the bits that follow the range's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "key long, chunk long, a binary, b binary, c binary, d binary"
CHUNK_DOCS, CHUNK_KEYS, HEAVY = 2048, 1_000_000, 24
#: Keys that one range should hold at most, about; the number of ranges follows the size of the corpus.
RANGE_KEYS = 400_000


def range_bits(docs: DataFrame, range_keys: int = RANGE_KEYS, chars_per_key: float = 6.0) -> int:
    """Bits for as many ranges as the corpus needs, from the length of all its texts."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(chars / chars_per_key / range_keys, 1))), 4, 30))


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["key", "chunk", "a", "b", "c", "d"])


def placed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each key and a name of 32 bits in it, enough to count by."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64), ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def width(bits: int) -> int:
    return min(48, 64 - bits)


def long_names(keys: np.ndarray, bits: int) -> np.ndarray:
    """Names of up to 48 bits: with the range's bits 52 in all at least, and all 64 from 2^16 ranges on."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - width(bits))


def to_bytes(names: np.ndarray) -> bytes:
    """Long names, six bytes each."""
    return names.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, "u1").reshape(-1, 6)
    out = np.zeros((len(six), 8), "u1")
    out[:, :6] = six
    return out.view("<u8").ravel()


def squeezed(numbers: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: all first bytes, then all second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers).view("u1").reshape(len(numbers), numbers.itemsize).T.tobytes(), 1)


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(size, -1).T).view(kind).ravel()


def full(range_number: int, names: np.ndarray, bits: int) -> np.ndarray:
    return (np.uint64(range_number) << np.uint64(width(bits))) | names


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return first, np.diff(np.r_[first, len(sorted_keys)])


def chunk_rows(chunk: int, head_a: bytes, head_b: bytes, keys_of: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows of one chunk: ``keys_of`` has the 64-bit keys of each document, repeated keys count each time.

    The chunk's own row keeps ``head_a``, ``head_b``, how often each heavy key occurs, and the documents of those.
    A range's row has the light keys and their documents, the heavy keys and how often they occur.
    """
    keys = np.concatenate(keys_of)
    doc = np.repeat(np.arange(len(keys_of), dtype="<u2"), [len(k) for k in keys_of])
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first, count = runs(keys)
    many = count >= HEAVY
    in_many = np.repeat(many, count)
    heavy, heavy_count = keys[first[many]], count[many].astype("<u4")
    light, light_doc = keys[~in_many], doc[~in_many]
    rows = [(-1 - chunk, chunk, head_a, head_b, heavy_count.tobytes(), doc[in_many].tobytes())]
    at, heavy_at = ((k >> np.uint64(64 - bits)).astype(np.int64) for k in (light, heavy))
    name, heavy_name = long_names(light, bits), long_names(heavy, bits)
    ranges = np.union1d(at, heavy_at)
    cuts = [np.searchsorted(k, np.append(ranges, 1 << bits)).tolist() for k in (at, heavy_at)]
    for r, a, b, x, y in zip(ranges.tolist(), cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]):
        rows.append((r, chunk, to_bytes(name[a:b]), light_doc[a:b].tobytes(), to_bytes(heavy_name[x:y]), heavy_count[x:y].tobytes()))
    return row_batch(rows)
