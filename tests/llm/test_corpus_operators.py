"""Joins, near duplicates, neighbours, language models, classifier and pipeline against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, components, lm, neardup, ngram_join, quality
from tidemark.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(sets, ids, percent=85):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(sets))]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 200)] + [(301, 300), (300, 301)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["", None, "  \t ", "one", "ONE", "one two", "shared passage of words " * 30 + "tail a", "shared passage of words " * 30 + "tail b", "x " * 5000]
    df = spark.createDataFrame([(i * 3 + 1, t, 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, n int, key string")
    got = {r.doc_id: r for r in ngram_join.join_documents(df).collect()}
    sets = [shingle_set(t) for t in texts]
    want = classes(sets, [i * 3 + 1 for i in range(len(texts))])
    assert [got[i * 3 + 1].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i * 3 + 1].component_id for i in range(len(texts))] == want
    assert ngram_join.join_documents(df.limit(0)).count() == 0
    twice = ngram_join.join_documents(df.limit(3).unionByName(df.limit(3)).selectExpr("if(doc_id = 1, null, doc_id) as doc_id", "text")).collect()
    assert len(twice) == 6 and sum(r.doc_id is None for r in twice) == 2


def test_keep_one_document_of_each_group(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words), (2, words + " x"), (2, words + " x"), (3, "other text of its own"), (4, None), (5, "")]
    got = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect())
    assert [i for i, _ in got] == [1, 3, 4, 5]


def test_near_duplicate_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.09).astype(np.float32).tolist(), k % 3))
    rows += [(len(rows) + i, rows[4][1], rows[4][2]) for i in range(5)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, rows[0][1], None), (9005, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "vec_id long, embedding array<float>, label int, v double")
    got = {r.vec_id: r for r in neardup.link_vectors(df, block=16).collect()}
    x = np.array([r[1] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    root = neardup._root(len(rows), *np.nonzero(near))
    assert [got[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)
    assert neardup.link_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (1, [0.0, 1.0, 0.0], 1), (5, [0.0, 0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.link_vectors(twice).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (5, 0, 5)]


def test_planted_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2000] = unit_rows(x[0] + 0.5 * x[:2000])  # a loose group that holds one third
    side = rng.normal(size=(500, 64))
    side -= np.einsum("ij,ij->i", side, x[:500])[:, None] * x[:500]
    cosine = rng.uniform(0.9801, 0.985, (500, 1))
    x[5500:] = cosine * x[:500] + np.sqrt(1 - cosine**2) * unit_rows(side)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in neardup.link_vectors(df).collect()}
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() and want.sum() >= 1000


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_no_near_vector_is_lost_in_a_dense_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    x = rng.normal(size=(3000, 64))
    x[:1000] = centre / np.linalg.norm(centre) + rng.normal(size=(1000, 64)) * 0.0137
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in neardup.link_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    assert [got[i] for i in range(len(x))] == (near.sum(1) - 1).tolist() and near.sum() > 100_000


def test_neighbours_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[10:20] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1020, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block=256).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20)) and all(len(v) == 20 for v in found.values())
    d, hits = x.astype(float), 0
    for q, near in found.items():
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hits += len(set(order) & {v for v, _ in near})
        assert all(math.isclose(s[v], score, rel_tol=1e-12) for v, score in near) and near == sorted(near, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(found)) >= 0.9
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id >= 1000"), F.col("vec_id") % 20 == 0).count() == 0


def test_language_models_equal_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(["a", "b", "c", "dd", "e"], k=rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (None, "a b")]
    target = ["a b a b c", "a b"]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).collect()}

    def counts(texts):
        word, pair = collections.Counter(), collections.Counter()
        for t in texts:
            w = ["<s>", *(t or "").split()]
            if len(w) > 1:
                word.update(w)
                pair.update(zip(w, w[1:]))
        return word, pair

    size = len({w for t in [*target, *(t for _, t in docs)] for w in (t or "").split()})

    def loss(model, text):
        (word, pair), w = model, ["<s>", *text.split()]
        n = word.total() - word["<s>"]
        return sum(-math.log((pair[a, b] + 5 * (word[b] + 0.5) / (n + 0.5 * size)) / (word[a] + 5)) for a, b in zip(w, w[1:])) / max(1, len(w) - 1)

    every, aim = counts([t for _, t in docs]), counts(target)
    for i, t in docs:
        if t:
            others = tuple(a - b for a, b in zip(every, counts([t])))
            assert abs(got[i].target_loss - loss(aim, t)) < 1e-9 and abs(got[i].background_loss - loss(others, t)) < 1e-9
    assert got[900].n_tokens == 0 and got[900].score == 0 and got[901].target_loss is None
    assert len(lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string").limit(0), spark.createDataFrame([], "text string")).collect()) == 0


def test_classifier_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    aside = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r, _ in aside)
    assert np.mean([r.predicted == q for r, q in aside]) > 0.93


def test_classifier_on_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "text", 0.3), (3, "w " * 20000, 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(docs, none).collect()] == [0.5] * 5
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == 5
    assert quality.score_quality(docs.limit(0), none).count() == 0


def test_pipeline_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert after.columns == columns and after.count() <= docs.count()
        if name == "personal_data":
            assert after.count() == docs.count()
        if name == "ngram_jaccard_join":
            kept = {r.doc_id for r in after.collect()}
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            want = classes([shingle_set(t, 5) for _, t in rows], [i for i, _ in rows], 80)
            assert kept == {i for (i, _), c in zip(rows, want) if i == c}
        if name == "best_fit_packing":
            assert after.select("doc_id").distinct().count() == docs.count()
        docs = after


@pytest.mark.parametrize("name", sorted(queries()))
def test_every_query_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0
