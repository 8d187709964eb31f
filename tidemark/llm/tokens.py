"""Token ids of whole texts with the public byte-level vocabulary ``byte_bpe_50k.json``.

A special token of the file is one id wherever its string stands in a text. What lies between is cut before every
single space that stands between two visible characters. The vocabulary's pattern never lets a token reach over such a
cut, so distinct pieces are remembered and only new ones encoded, joined into one string whose ids are dealt back to
the pieces by their byte lengths; a text with runs of white space, or with some at an end, is encoded whole. The file's tokens are ranks of one byte-pair encoding; new pieces go through them in a library
that encodes several times faster than the one the file was written for. Tests hold the ids against the latter.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import worker_cache

CACHE_ENTRIES = 150_000
#: White space beside a space or at an end: words split at spaces that no piece may be.
_BORDER = re.compile(r" (?=\s|$)|[^\S ](?= )|\s$")


def token_bytes() -> dict[str, int]:
    """Byte of each character in which a byte-level vocabulary is written: itself if printable, else one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        byte = token_bytes()
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in self.special}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.coder = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(token) for token in ranks]
        #: Known pieces, their ids one after the other, and where those of each begin and end.
        self.known, self.ids, self.spans = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros((2, 0), np.int64)

    def _learn(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words with one space before each, where those of each word end, and which words border on white
        space: those are no pieces and get ids of no meaning."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, bool)
        joined = " ".join(["", pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()])
        bad = np.zeros(len(words), bool)
        if _BORDER.search(joined):
            bad[:] = [not w or w[0].isspace() or w[-1].isspace() for w in joined[1:].split(" ")]
        raw = np.array(self.coder.encode_ordinary(joined), "<u4")
        sizes = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return raw, np.searchsorted(np.cumsum(self.widths[raw]), sizes) + 1, bad

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text]))[0]

    def encode_batch(self, texts: pa.StringArray, limit: int = 1 << 22) -> list[np.ndarray]:
        """Ids of each text, about ``limit`` bytes at a time."""
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)] if len(texts) else [0]
        return [ids for a, b in zip(cuts, cuts[1:]) for ids in self._encode(texts.slice(a, b - a))]

    def _encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, self.known)
        unknown = place.is_null()
        new = coded.dictionary.filter(unknown)
        raw, ends, bad = self._learn(new)
        is_new = unknown.to_numpy(zero_copy_only=False)
        span, unfit = np.zeros((2, len(place)), np.int64), np.zeros(len(place), bool)
        span[:, ~is_new] = self.spans[:, place.filter(pc.invert(unknown)).to_numpy()]
        span[:, is_new], unfit[is_new] = np.stack([np.r_[0, ends][:-1], ends]) + len(self.ids), bad
        start, length = span[0], span[1] - span[0]
        buffer = np.concatenate([self.ids, raw])
        word = coded.indices.to_numpy()
        cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        heads = coded.dictionary.take(pa.array(word[cut[:-1]])).to_pylist()
        slow = np.logical_or.reduceat(np.where(_at(cut, len(word)), False, unfit[word]), cut[:-1]).tolist()
        for special in self.special:
            slow = [a or b for a, b in zip(slow, pc.match_substring(texts, special).to_pylist())]
        size = np.where(_at(cut, len(word)), 0, length[word])
        stop = np.cumsum(size)
        ids = buffer[np.repeat(start[word] - stop + size, size) + np.arange(stop[-1])]
        stop = np.r_[0, stop][cut].tolist()
        out = [
            np.frombuffer(self._with_special(texts[k].as_py()), "<u4") if late else np.concatenate([np.frombuffer(self.plain(head), "<u4"), ids[a:b]])
            for k, (late, head, a, b) in enumerate(zip(slow, heads, stop, stop[1:]))
        ]
        if len(self.known) < CACHE_ENTRIES:
            self.known = pa.concat_arrays([self.known, new.filter(pa.array(~bad))])
            self.spans = np.hstack([self.spans, span[:, is_new][:, ~bad]])
            self.ids = buffer
        return out

    def _with_special(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        return b"".join(self.plain(p) if k % 2 == 0 else np.array([self.special[p]], "<u4").tobytes() for k, p in enumerate(parts))


def _at(cut: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words are the first of a text."""
    out = np.zeros(n, bool)
    out[cut[:-1]] = True
    return out


def strings(column: pa.BinaryArray) -> pa.StringArray:
    """Bytes as text; those that are no UTF-8 are replaced."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    kept = worker_cache("tokens")
    if (path, pattern) not in kept:
        kept[path, pattern] = Encoder(path, pattern)
    return kept[path, pattern]
