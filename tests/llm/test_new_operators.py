"""Resampling, clustering and repeated substrings against brute force, with the cases that break careless code."""

import collections
import hashlib
import json
import base64
import math
import random
import re
import zlib

import numpy as np

from tidemark.llm import clustering, lm, quality, resampling, secret_scan, substrings
from tidemark.llm.corpus_counts import squeezed, unsqueezed

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(raw)
    return w, [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent):
    s, t = (collections.Counter(b for _, text in rows for b in features(text)[1]) for rows in (docs, target))
    n, m = sum(s.values()), sum(t.values())
    out, able = [], []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= 20:
            able.append(out[-1])
    for k, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: percent * len(able) // 100], 1):
        row[4] = k
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "déjà", "vu　", "x1", "co-op", "naïve", "ÉTÉ", "a b", "tab\tbed", "nul\x00byte", "und_er", "\x1funit"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 60])))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "..., !"), (503, "long word " * 20_000), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(600 + i, "same text of a copied page " * 5) for i in range(70)]
    target = [(1, "Beta GAMMA déjà alpha x1 " * 9), (2, None), (3, "")]
    df = spark.createDataFrame([(*d, 1.0, "k", 2) for d in docs], "doc_id long, text string, score double, bucket string, n_words int")
    aim = spark.createDataFrame([(*t, 0) for t in target], "item_id int, text string, doc_id int")
    for percent in (5, 40, 100):
        got = sorted((tuple(r) for r in resampling.resample(df, aim, percent).collect()), key=str)
        want = resampled(docs, target, percent)
        if percent < 100:  # the repeated rows of document 7 tie with themselves
            assert got == want
        assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))
        assert [r[:4] for r in got] == [r[:4] for r in want] or percent == 100
    assert resampling.resample(df.limit(0), aim).count() == 0
    empty = resampling.resample(df, aim.limit(0)).collect()
    assert len(empty) == len(docs) and all(r.weight is not None for r in empty)
    assert resampling.resample(spark.createDataFrame([(None, "w " * 30)], "doc_id long, text string"), aim, 100).first()["rank"] == 1


def test_checksums_of_runs_are_chained():
    w = resampling.words("One two  THREE ünd four".encode())
    assert w == [b"one", b"two", b"three", "ünd".encode(), b"four"]
    assert list(resampling.checksums(w)) == [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(6 - n)]


def lloyd(rows, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())[:k]]
    for last in range(rounds + 1):
        to = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if last < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, own) in zip(kept, to) if own == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    per = collections.Counter()
    for d, j in to:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(kept, to))


def test_clustering_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 0.02 + (i % 5)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(9, rows[9][1]), (9, rows[9][1])]  # copies and repeated rows
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] + [1.0] * 63), (2003, [float("inf")] * 64), (2004, [None] + [0.0] * 63), (2005, []), (2006, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], "vec_id long, embedding array<float>, cluster int, v int")
    for k, rounds in ((40, 5), (7, 2), (1, 1)):
        assert sorted(map(tuple, clustering.cluster_vectors(df, k, rounds).collect())) == lloyd(rows, k, rounds)
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, clustering.cluster_vectors(few).collect())) == lloyd(rows[:5], 40, 5)
    assert clustering.cluster_vectors(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r.distance for r in clustering.cluster_vectors(huge, 1, 0).collect()] in ([0, 64 << 56], [64 << 56, 0])
    assert clustering.cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], "vec_id long, embedding array<double>")).first()["distance"] == 0


def test_orchard_search_skips_and_keeps_ties():
    rng = np.random.default_rng(5)
    centres = np.r_[rng.integers(0, 4, (30, 3)), rng.integers(900, 904, (30, 3))].astype(np.int64)  # many equal distances
    x = np.r_[rng.integers(0, 5, (400, 3)), rng.integers(899, 905, (400, 3))].astype(np.int64)
    best, distance, measured = clustering.orchard_search(x, centres, clustering.orchard_lists(centres), rng.integers(0, 60, 800))
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 0.8 * every.size


def removed(rows, length=200):
    seen = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[1 + p : 1 + p + length] = True
        edge = np.flatnonzero(np.diff(gone))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return sorted(out, key=str)


def test_repeated_substrings_equal_brute_force(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, edge, short = noise(260), noise(200), noise(199)
    texts = [None, "", noise(199), noise(200), "z" * 150, "z" * 200, "z" * 201, "z" * 900, "z" * 901, "ab" * 400, short + noise(50), noise(30) + short]
    texts += [noise(300) + edge + noise(5), edge, noise(20) + edge]
    texts += ["é" * 120 + noise(100), "x" + "é" * 120 + noise(90)]
    base = noise(3000)
    texts += [base, base, base[:1500] + "!" + base[1500:], base[700:900], base[700:899], base[10:1200] + noise(40) + base[1100:2500]]
    # more contexts around one anchor than go together
    texts += [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) for _ in range(400)]
    texts += [noise(150_000) + passage + noise(150_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, "own text of five")]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, part int, kept binary").repartition(3, "doc_id")
    got = sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in substrings.remove_repeats(df).collect()), key=str)
    assert got == removed([(i, (t or "").encode()) for i, t in rows])
    digest = {r.doc_id: r for r in substrings.removal_digest(df).collect()}
    assert digest[1].n_bytes == 0 and digest[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substrings.removal_digest(df.limit(0)).count() == 0
    assert substrings.remove_repeats(df.where("doc_id = 0").selectExpr("cast(null as long) as doc_id", "text")).first().doc_id is None


def test_merged_transforms_give_order_and_common_prefixes():
    rng = random.Random(2)
    shards = [[[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(n)] for n in (5, 1, 7)]
    transforms, suffixes = [], []
    for strings in shards:
        symbol = np.array([x for s in strings for x in s])
        ends = np.cumsum([len(s) for s in strings]) - 1
        before = np.arange(len(symbol)) - 1
        before[np.r_[0, ends[:-1] + 1]] = -1
        order = substrings.transform(symbol, before, ends)
        stop = np.searchsorted(ends, np.arange(len(symbol)))
        mine = [symbol[i : ends[stop[i]] + 1].tolist() if i < len(symbol) else [] for i in order.tolist()]
        assert mine == sorted(mine)
        previous = np.r_[before, ends][order]
        transforms.append(np.where(previous >= 0, symbol[previous], 0))
        suffixes += mine
    for rounds in (1, 3, 12):
        place, shared, interval = substrings.merge(transforms, [len(s) for s in shards], rounds)
        merged = [suffixes[i][:rounds] for i in place.tolist()]
        assert merged == sorted(merged)
        for k in range(1, len(merged)):
            a, b = suffixes[place[k - 1]], suffixes[place[k]]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(common, rounds)
            assert (interval[k] == interval[k - 1]) == (common >= rounds)


def test_a_small_shard_and_many_of_them_agree(monkeypatch):
    rng = random.Random(6)
    noise = lambda n: bytes(rng.choices(b"abcd", k=n))
    common = noise(400)
    texts = [noise(40) + common[a : a + 260] + noise(30) for a in range(0, 140, 7)] + [noise(330)]
    windows, data = np.array([len(t) - 199 for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    one = substrings.repeated(data, windows, np.ones(len(texts), np.int64))
    monkeypatch.setattr(substrings, "SHARD", 100)
    assert (substrings.repeated(data, windows, np.ones(len(texts), np.int64)) == one).all()
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    assert one.tolist() == [seen[t[p : p + 200]] > 1 for t in texts for p in range(len(t) - 199)]


def test_deeply_nested_token_header_is_no_secret():
    head = base64.urlsafe_b64encode(('{"a":' + "[" * 20_000).encode()).decode().rstrip("=")
    good = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert secret_scan.confirmed_spans(f"{head}.abc.def") == []
    assert [k for k, *_ in secret_scan.confirmed_spans(f"{good}.abc.def")] == ["jwt"]


def test_classifier_takes_a_table_with_a_column_named_as_its_label(spark):
    docs = spark.createDataFrame([(i, ("clear prose of some length " if i % 2 else "buy now !!! click ") * 5, 9, 1.0) for i in range(40)], "doc_id long, text string, quality int, features double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == 40
    assert set(quality.keep_good(docs, labels).columns) == {"doc_id", "text", "quality", "features"}


def test_totals_past_32_bits_are_whole():
    import pandas as pd

    rows = [(3, chunk, np.array([7, 9], "<u4").tobytes(), squeezed(np.array([0xFFFFFFFF, 5], "<u4")), b"", b"") for chunk in (0, 1, 2)]
    got = lm._count((3,), pd.DataFrame(rows, columns=["key", "chunk", "a", "b", "c", "d"]))
    assert [unsqueezed(x, "<i8").tolist() for x in got["a"]] == [[3 * 0xFFFFFFFF, 15]] * 3
    assert [unsqueezed(x, "<i8").tolist() for x in got["b"]] == [[0, 0]] * 3
