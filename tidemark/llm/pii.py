"""Personal data: base patterns plus information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers. Each distinct base value is a
protected entity. A word discloses an entity when its pointwise mutual information with the entity, over the documents
of the whole corpus, nearly reaches the entity's information content: PMI(t; e) / IC(e). They occur together when one
document holds both, however far apart. Words over ``remove_at`` are removed, words over ``generalise_at`` are
generalised to their shape, wherever they stand, also in documents without the entity.

Pairs are made only of entities with ``min_support`` documents and of words that are rare enough to reach
``generalise_at`` with them; tables of rounded counts, at most 2^24 places, say so in the scan. Two keys of one place
leave more pairs to count, never fewer, and the exact counts decide.

Defined results: null or empty text has no spans; repeated rows are each scanned; columns beside doc_id and text pass
through :func:`sanitise` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_rows, tidy

KINDS = ("email", "ip", "card", "phone")
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_REVERSED = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses in linear time: each @ is extended to the left as far as allowed."""
    end, n, reverse = 0, len(text), None
    for m in _DOMAIN.finditer(text):
        at = m.start()
        reverse = text[::-1] if reverse is None else reverse
        run = _LOCAL_REVERSED.match(reverse, n - at, n - end)
        if run:
            yield n - run.end(), m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _entity(kind: str, span: str) -> int:
    value = span.lower() if kind == "email" else _only_digits(span) if kind != "ip" else span
    return term_hash(f"{kind}\0{value}")


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with spaces in the place of its base spans: what every count and every mark takes terms from."""
    if not spans:
        return text
    parts, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        parts += [text[at:s], " " * (e - max(at, s))]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _words(rest: str) -> Iterator[tuple[str, int, int]]:
    """(lower-case term, start, end) of each word of a text without its base spans."""
    for m in _WORD.finditer(rest):
        word = m[0]
        a = m.start() + len(word) - len(word.lstrip(EDGE))
        if term := word.strip(EDGE):
            yield term.lower(), a, a + len(term)


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_HIT_TYPE = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_TERM, _ENTITY, _DOCUMENT = 0, 1, 2
#: Counts in the tables are steps of a quarter of their logarithm; a place without a live key has this one, or 0.
_NONE = 255


#: Bits of a term in the filter of disclosing terms, filter bits for each of them, and filter bits at most (16 MB).
_PROBES, _BITS_PER_TERM, _MOST_BITS = 6, 16, 27


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Filter places of each term hash, one row a probe."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(31)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(_PROBES)])


def _filter(terms: DataFrame) -> tuple[np.ndarray, int]:
    """Bit filter of the terms, of a size that follows their number up to a bound: it lets every one of them pass, and
    others rarely; beyond the bound more of them, which the join with the exact terms then drops."""
    bits = int(np.clip(np.ceil(np.log2(_BITS_PER_TERM * terms.count() + 1)), 10, _MOST_BITS))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": np.unique(_probes(batch["term"].to_numpy(np.int64), bits))})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"places": [np.unique(rows["place"].to_numpy("<i8")).astype("<i4").tobytes()]})

    flags = np.zeros(1 << bits, bool)
    found = terms.select("term").mapInPandas(places, "place long")
    for r in found.groupBy(F.shiftright("place", 20)).applyInPandas(pack, "places binary").toLocalIterator():
        flags[np.frombuffer(r.places, "<i4")] = True
    return np.packbits(flags), bits


def _hits(rest: str, flags: np.ndarray, bits: int) -> list[dict]:
    """Words of a text without its base spans that pass the filter ``flags``."""
    terms = list(_terms(rest))
    hashes = np.fromiter(map(term_hash, terms), np.int64, len(terms))
    maybe = {terms[k]: int(hashes[k]) for k in np.flatnonzero(flags[_probes(hashes, bits)].all(0)).tolist()}
    return [{"term": maybe[t], "start": a, "end": b} for t, a, b in _words(rest) if t in maybe] if maybe else []


def _scan(wanted: np.ndarray, bits: int):
    """Base spans of each text, and its words outside them that may be among the terms of the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted).view(bool)
        for batch in batches:
            counts, joined, digests, hits = {k: [] for k in KINDS}, [], [], []
            for raw in batch.column("text"):
                text = raw.as_py().decode("utf-8", "replace")
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in spans))
                joined.append(_joined(spans))
                digests.append(hashlib.sha256(joined[-1].encode()).hexdigest())
                hits.append(_hits(without(text, spans), flags, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(joined, pa.string()), pa.array(digests, pa.string()), pa.array(hits, _HIT_TYPE)],
                names=["row", "doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "hits"],
            )

    return run


def _terms(rest: str) -> set[str]:
    terms = {m.strip(EDGE) for m in set(rest.split())}
    return set(map(str.lower, terms)) - {""}


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term and per entity, and all documents, pre-aggregated in the task; flushed before the
    dictionary grows large."""
    terms: Counter[str] = Counter()
    others: Counter[tuple[int, int]] = Counter()

    def flush():
        kinds = [_TERM] * len(terms) + [k for k, _ in others]
        keys = [*map(term_hash, terms), *(x for _, x in others)]
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array([*terms.values(), *others.values()], pa.int64())], names=["kind", "key", "n"])

    for batch in batches:
        for raw in batch.column("text"):
            text = raw.as_py().decode("utf-8", "replace")
            spans = base_spans(text)
            terms.update(_terms(without(text, spans)))
            others.update((_ENTITY, e) for e in {_entity(k, text[s:e]) for k, s, e in spans})
            others[_DOCUMENT, 0] += 1
            if len(terms) + len(others) > 150_000:
                yield flush()
                terms.clear()
                others.clear()
    if others:
        yield flush()


def _pairs(entities: np.ndarray, terms: np.ndarray, bound: float, share: float):
    """Per document and live entity in it, the terms that are rare enough to disclose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lists, held = [], [], 0
            for raw in batch.column("text"):
                text = raw.as_py().decode("utf-8", "replace")
                spans = base_spans(text)
                own = {e for e in {_entity(k, text[s:e]) for k, s, e in spans} if entities[e & (len(entities) - 1)]}
                if own:
                    hashes = np.array([term_hash(t) for t in _terms(without(text, spans))], np.int64)
                    level = terms[hashes & (len(terms) - 1)]
                for e in own:
                    keep = hashes[(level != _NONE) & (level <= 4 * bound + share * entities[e & (len(entities) - 1)] + 1e-6)]
                    if len(keep):
                        found.append(e)
                        lists.append(keep)
                        held += len(keep)
                    if held > 500_000:
                        yield _pair_batch(found, lists)
                        found, lists, held = [], [], 0
            yield _pair_batch(found, lists)

    return run


def _pair_batch(found: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), terms], names=["entity", "terms"])


def _levels(counts: DataFrame, rarest: bool) -> np.ndarray:
    """Table of rounded counts (key, n) by the last bits of the key: of two keys the rarer or the more frequent one."""
    bits = int(np.clip(np.ceil(np.log2(4 * counts.count() + 1)), 10, 24))
    step = 4 * F.log2(F.col("n").cast("double"))
    level = (F.min(F.floor(step)) if rarest else F.max(F.ceil(step))).cast("int")
    places = counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("place")).agg(level.alias("level"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"places": [rows["place"].to_numpy("<i4").tobytes()], "levels": [rows["level"].to_numpy("u1").tobytes()]})

    table = np.full(1 << bits, _NONE if rarest else 0, np.uint8)
    for r in places.groupBy(F.shiftright("place", 16)).applyInPandas(pack, "places binary, levels binary").collect():
        table[np.frombuffer(r.places, "<i4")] = np.frombuffer(r.levels, "u1")
    return table


def disclosing_terms(docs: DataFrame, min_support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """Terms that disclose an entity of ``docs``, and what becomes of them: term (hash), action."""
    every = text_rows(docs)
    counts = stored(every.mapInArrow(tidy(_document_counts), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= min_support) | (F.col("kind") == _DOCUMENT)))
    total = max((r.n for r in counts.where(F.col("kind") == _DOCUMENT).collect()), default=1)
    entities = counts.where((F.col("kind") == _ENTITY) & (F.col("n") < total)).select("key", "n")
    terms = counts.where(F.col("kind") == _TERM).select("key", "n")
    pairs = every.mapInArrow(tidy(_pairs(_levels(entities, False), _levels(terms, True), (1 - generalise_at) * math.log2(total), generalise_at)), "entity long, terms array<long>")
    both = pairs.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_support)
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    return stored(
        both.join(entities.select(F.col("key").alias("entity"), F.col("n").alias("n_entity")), "entity")
        .join(terms.select(F.col("key").alias("term"), F.col("n").alias("n_term")), "term")
        .select("term", (pmi / information).alias("ratio"))
        .where(F.col("ratio") >= generalise_at)
        .groupBy("term")
        .agg(F.when(F.max("ratio") >= remove_at, "remove").otherwise("generalise").alias("action"))
    )


def _marked(hits: DataFrame, row: str, disclosing: DataFrame) -> DataFrame:
    """Hits (row, array ``hits``) that are disclosing terms, gathered again by row: row, terms."""
    return hits.select(row, F.explode("hits").alias("h")).select(row, "h.*").join(disclosing, "term").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))


def find_personal_data(docs: DataFrame, **parameters) -> DataFrame:
    """Per input row: row, doc_id, counts by kind, base spans with their digest, and the disclosing terms.

    ``terms`` is array<struct<start, end, action>>. ``row`` numbers the rows of the result alone and must not be joined to
    another scan of ``docs``.
    """
    disclosing = disclosing_terms(docs, **parameters)
    text = text_rows(docs.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id")
    found = stored(text.mapInArrow(tidy(_scan(*_filter(disclosing))), f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, hits array<struct<term: long, start: long, end: long>>"))
    return found.drop("hits").join(_marked(found.where(F.size("hits") > 0), "row", disclosing), "row", "left")


def personal_data_digest(docs: DataFrame, **parameters) -> DataFrame:
    """The contract's columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    terms = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), terms)
    return find_personal_data(docs, **parameters).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def _shape(term: str) -> str:
    return "<number>" if any(c.isdigit() for c in term) else "<word>"


def rewrite(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """Base spans become their kind in brackets, removed terms nothing, generalised terms their shape."""
    edits = [(s, e, f"[{k.upper()}]") for k, s, e in base]
    edits += [(s, e, "" if action == "remove" else _shape(text[s:e])) for s, e, action in terms]
    out, at = [], 0
    for s, e, new in sorted(edits):
        if s < at:  # spans of two kinds may overlap: the later one ends the cut
            at = max(at, e)
            continue
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


#: Columns beside a document's own; names that no table has.
_ROW, _HITS, _TERMS = "__tidemark_row", "__tidemark_hits", "__tidemark_terms"


def _replaced(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _rewrite(wanted: np.ndarray, bits: int):
    """Rows with base spans replaced where no word passes the filter; the others as they are, with their words that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted).view(bool)
        for batch in batches:
            texts, hits = [], []
            for raw in batch.column("text").to_pylist():
                spans = base_spans(raw or "")
                found = _hits(without(raw or "", spans), flags, bits)
                texts.append(rewrite(raw, spans, []) if spans and not found else raw)
                hits.append(found or None)
            yield _replaced(batch, texts).append_column(_HITS, pa.array(hits, _HIT_TYPE))

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with base spans and disclosing terms replaced."""
    for batch in batches:
        texts = [rewrite(raw, base_spans(raw), [(t["start"], t["end"], t["action"]) for t in terms or []]) for raw, terms in zip(batch.column("text").to_pylist(), batch.column(_TERMS).to_pylist())]
        yield _replaced(batch, texts).drop_columns([_TERMS])


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; other columns as they were.

    One pass replaces base spans in rows without a word that may disclose something, and numbers and marks the others.
    Its result is stored, so that row numbers stay with their texts; only marked rows are joined and read again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    disclosing = disclosing_terms(docs, **parameters)
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    scanned = stored(numbered.mapInArrow(tidy(_rewrite(*_filter(disclosing))), f"{schema}, `{_ROW}` long, `{_HITS}` array<struct<term: long, start: long, end: long>>"))
    open_rows = scanned.where(F.col(_HITS).isNotNull())
    terms = _marked(open_rows.select(_ROW, F.col(_HITS).alias("hits")), _ROW, disclosing).withColumnRenamed("terms", _TERMS)
    marked = open_rows.drop(_HITS).join(terms, _ROW, "left").select(*docs.columns, _TERMS)
    return scanned.where(F.col(_HITS).isNull()).select(*docs.columns).unionByName(marked.mapInArrow(tidy(_finish), schema).select(*docs.columns))
