"""Scenario scores and bootstraps of a user's statistic against plain loops; what a task holds stays bounded."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import extension, memory
from tidemark.streaming import jobs


def _snapshots(spark, body):
    rng = random.Random(3)
    pool = [(round(rng.expovariate(0.1), 2), body(rng), rng.random() < 0.5, rng.randrange(5) / 5, rng.randrange(9) / 3) for _ in range(40)]
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(60), *rng.choice(pool)) for i in range(600)]
    schema = "id long, scenario long, range_pct double, body_pct double, is_bullish boolean, close_position double, volatility double"
    return rows, spark.createDataFrame(rows, schema)


def _expected(rows):
    clip = lambda v: min(1.0, max(0.0, v))
    out = {}
    for q in rows[::10]:
        for s in rows:
            if q[0] != s[0]:
                v = 0.25 * (1 - clip(abs(q[2] - s[2]) / 10)) + 0.2 * (1 - abs(q[3] - s[3])) + 0.25 * (q[4] == s[4]) + 0.15 * (1 - abs(q[5] - s[5])) + 0.15 * (1 - clip(abs(q[6] - s[6]) / 5))
                out.setdefault((q[0], s[1]), []).append(clip(v))
    return {k: sum(v) / len(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [65_536, 50])  # 200 snapshots of scenario 7 are cut into blocks of 50
@pytest.mark.parametrize("body", [lambda rng: rng.randrange(7) / 7, lambda rng: rng.uniform(-3, 3)])  # parts below 0 do not add up
def test_scenarios_against_loops(spark, body, block):
    rows, own = _snapshots(spark, body)
    queries, want = own.where("id % 10 = 0"), _expected(rows)
    scores = {(r.query_id, r.scenario): r.score for r in memory.scenario_scores(queries, own, block, 16).collect()}
    assert scores.keys() == want.keys() and all(abs(scores[k] - want[k]) < 1e-12 for k in want)
    per = {}
    for (_, s), v in want.items():
        per.setdefault(s, []).append(v)
    got = {r.scenario: (r.queries, round(r.mean, 9), round(r.best, 9)) for r in memory.scenario_summary(queries, own, block, 16).collect()}
    assert got == {s: (len(v), round(sum(v) / len(v), 9), round(max(v), 9)) for s, v in per.items()}
    best = {(r.query_id, r["rank"]): r.scenario for r in memory.scenario_matches(queries, own, 5, 0.3, block, 16).collect()}
    for q in {q for q, _ in want}:
        ranked = sorted((-round(v, 9), s) for (a, s), v in want.items() if a == q and v >= 0.3)[:5]
        assert [best[(q, k + 1)] for k in range(len(ranked))] == [s for _, s in ranked] and (q, len(ranked) + 1) not in best


def test_a_task_compares_few_cells_at_once(spark, monkeypatch):
    monkeypatch.setattr(memory, "CELLS", 3000)
    _, own = _snapshots(spark, lambda rng: rng.randrange(7) / 7)
    rows = own.toPandas()
    sizes = [total.size for _, _, total, _ in memory._compared(pd.concat([rows.assign(asks=False), rows.assign(asks=True)]))]
    assert len(sizes) == 120 and max(sizes) <= 3000


def test_bootstrap_of_values_over_pages(spark, monkeypatch):
    monkeypatch.setattr(extension, "PAGE", 5)
    monkeypatch.setattr(extension, "ROWS", 7)
    rng = random.Random(5)
    df = spark.createDataFrame([(g, float(rng.randrange(23)), k) for k, g in enumerate(["a"] * 150 + ["b"] * 60 + [None] * 20)], "g string, v double, k long")
    median = lambda v, w: v[min(np.searchsorted(np.cumsum(w), w.sum() / 2), len(v) - 1)]
    got = {r.g: (round(r.mean, 9), r.replicates) for r in extension.bootstrap_statistic(df, "v", "k", "g", median, 40).collect()}
    rows = df.selectExpr("g", "v", "xxhash64(k) AS h").collect()
    mask, want = 2**64 - 1, {}
    for g in ("a", "b", None):
        found = []
        for r in range(40):
            weight = {}
            for row in (x for x in rows if x.g == g):
                m = ((row.h & mask) ^ (7 * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 & mask)) * 0x94D049BB133111EB & mask
                m ^= m >> 31
                u = (m * 0xD6E8FEB86659FD93 & mask) >> 11
                weight[row.v] = weight.get(row.v, 0) + int(np.searchsorted(extension._POISSON, u / 2**53))
            v = np.array(sorted(weight))
            found.append(median(v, np.array([weight[x] for x in v], float)))
        want[g] = (round(sum(found) / 40, 9), 40)
    assert got == want


def test_a_stream_fold_takes_a_batch_in_slices(monkeypatch):
    monkeypatch.setattr(jobs, "SLICE", 100)
    rng = random.Random(9)
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randrange(300)), k, rng.random()) for k in range(1000)]
    rng.shuffle(rows)
    whole = pd.DataFrame(rows, columns=["ts", "seq", "value"])
    slices = list(jobs._in_order(iter([whole[lo : lo + 37] for lo in range(0, 1000, 37)]), "value"))
    assert [len(v) for _, v in slices] == [100] * 10
    want = whole.sort_values(["ts", "seq"])
    assert [v for _, values in slices for v in values] == want["value"].tolist()
    assert np.concatenate([t for t, _ in slices]).tolist() == want["ts"].to_numpy().tolist()
