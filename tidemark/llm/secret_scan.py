"""Secrets: base patterns plus structural confirmation.

Candidates in base64 or hexadecimal are decoded; a span is added only if the bytes parse as a key: DER whose nested
lengths fill the value exactly, an OpenSSH private key whose fields and public keys fill it exactly, an SSH wire-format
public key, or a token whose first segment is a JSON header naming an algorithm. An encrypted PEM key has no structure
inside; it is confirmed by its two headers, whose vector decodes, and a body of whole cipher blocks. Null or empty text has no spans; each row is scanned by itself, whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_rows

KINDS = ("assign", "access", "hex")
#: Kinds that structural confirmation adds, in the order in which equal starts are listed.
CONFIRMED = ("der", "ssh", "jwt", "pem")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = re.compile(rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)?")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|AAAA|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{30,}={0,2}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]+-----")
_LOCKED = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s+Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,16})\s+([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]*PRIVATE KEY-----")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|[0]{6})[0-9A-Fa-f]{38,}")


_OPENSSH = b"openssh-key-v1\0"


def _decode64(s: str) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_value(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """End of the DER value at ``at`` if its length, and those nested in it, fit; else None."""
    if at + 2 > end or depth > 16:
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body : body + n], "big"), body + n
    stop = body + size
    if stop > end:
        return None
    if tag & 0x20:
        inside = body
        while inside < stop:
            nxt = der_value(data, inside, stop, depth + 1)
            if nxt is None:
                return None
            inside = nxt
    elif tag & 0x1F not in (1, 2, 3, 4, 5, 6, 12, 19, 22, 23, 24) and not tag & 0x80:
        return None
    return stop


def wire_strings(data: bytes) -> int | None:
    """Number of length-prefixed strings that fill ``data`` exactly; else None."""
    at = n = 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        n += 1
    return n if at == len(data) else None


def _field(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The length-prefixed field at ``at`` and where it ends."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else (None, at)


def openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, so many public keys and one private part, no more."""
    at = len(_OPENSSH)
    cipher, at = _field(data, at)
    kdf, at = _field(data, at)
    options, at = _field(data, at)
    if not cipher or not kdf or options is None or (cipher == b"none") != (kdf == b"none") or not re.fullmatch(rb"[a-z0-9@.-]+", cipher + kdf):
        return False
    number, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= number <= len(data) // 8:
        return False
    for _ in range(number):
        public, at = _field(data, at)
        if public is None or (wire_strings(public) or 0) < 2:
            return False
    private, at = _field(data, at)
    return bool(private) and len(private) % 8 == 0 and at == len(data)


def key_kind(data: bytes | None) -> str | None:
    if not data or len(data) < 20:
        return None
    if data[0] == 0x30:
        inner = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
        if der_value(data, 0, len(data)) == len(data) and (data[inner] if inner < len(data) else 0) in (0x02, 0x30):
            return "der"
    if data.startswith(_OPENSSH):
        return "ssh" if openssh_key(data) else None
    if data[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13") and data[4:8] in (b"ssh-", b"ecds") and (wire_strings(data) or 0) >= 2:
        return "ssh"
    return None


def is_token(s: str) -> bool:
    try:
        head = json.loads((_decode64(s.split(".")[0]) or b"").decode("utf-8"))
    except (ValueError, RecursionError):  # a header nested that deep signs nothing
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = {("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_token(m[0])}
    for m in _BASE64.finditer(text):
        if kind := key_kind(_decode64(m[0])):
            out.add((kind, *m.span()))
    for m in _HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            out.add((kind, *m.span()))
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if kind := key_kind(_decode64(m[1])):
                out.add((kind, *m.span()))
        for m in _LOCKED.finditer(text):
            body = _decode64(m[2])
            if body and len(body) % 8 == 0:
                out.add(("pem", *m.span()))
    return sorted(out, key=lambda x: (x[1], CONFIRMED.index(x[0])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = KINDS + CONFIRMED
    for batch in batches:
        rows = []
        for raw in batch.column("text"):
            text = raw.as_py().decode("utf-8", "replace")
            base = base_spans(text)
            every = sorted(base + confirmed_spans(text), key=lambda x: (x[1], order.index(x[0])))
            rows.append((*(sum(x[0] == k for x in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 of the base spans, and all spans."""
    id_type = dict(docs.dtypes)["doc_id"]
    return text_rows(docs, "doc_id").mapInArrow(_scan, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
