"""Scores of scenarios from lines and tents against all pairs; pairs that are met grow far slower than all pairs."""

import pickle

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import memory, scenarios


def _rows(n: int, seed: int, scenario_size: int = 6) -> pd.DataFrame:
    """Snapshots in scenarios of 1 to many, a part of them with range 0 and a part with ranges of their own."""
    rng = np.random.default_rng(seed)
    scenario = rng.integers(0, n // scenario_size, n)
    scenario[:5] = np.arange(5) + n  # asked snapshots alone in their scenario, which has no score for them
    return pd.DataFrame({
        "id": np.arange(n), "scenario": scenario, "range_pct": np.where(rng.random(n) < 0.1, 0.0, rng.exponential(150, n)), "body_pct": rng.integers(0, 7, n) / 7,
        "is_bullish": rng.integers(0, 2, n).astype(float), "close_position": rng.integers(0, 2, n) / 5, "volatility": rng.integers(0, 3, n) / 3,
    })


def _packed(asked: pd.DataFrame, floor: float) -> pd.DataFrame:
    own = asked.groupby(list(scenarios.COLUMNS)).size().reset_index(name="n").sort_values([*scenarios.REST, "range_pct"])
    out = []
    for lo in range(0, len(own), 50):
        part = own[lo : lo + 50]
        out.append(pickle.dumps((part[list(scenarios.REST)].to_numpy(), np.arange(len(part)), np.full(len(part), floor), part["range_pct"].to_numpy(), part["n"].to_numpy())))
    return pd.DataFrame({"part": range(len(out)), "data": out})[::-1]


def _scores(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    side = lambda df: {c: df[c].to_numpy(float) for c in scenarios.COLUMNS}
    like = memory.similarity(side(asked), side(rows))
    q, s = np.indices(like.shape)
    pairs = pd.DataFrame({"query_id": asked["id"].to_numpy()[q.ravel()], "id": rows["id"].to_numpy()[s.ravel()], "scenario": rows["scenario"].to_numpy()[s.ravel()], "score": like.ravel()})
    return pairs[pairs["query_id"] != pairs["id"]].groupby(["query_id", "scenario"])["score"].mean().reset_index()


@pytest.fixture
def met(monkeypatch):
    pairs = []
    tents = scenarios.Scenarios.tents
    monkeypatch.setattr(scenarios.Scenarios, "tents", lambda self, code, value: pairs.append(len(code)) or tents(self, code, value))
    return pairs


@pytest.mark.parametrize("cells", [2_000_000, 97])
@pytest.mark.parametrize("size", [3, 6, 100])
def test_figures_of_scenarios_against_all_pairs(monkeypatch, cells, size):
    monkeypatch.setattr(scenarios, "CELLS", cells)
    rows = _rows(600, size, size)
    asked = rows[(rows["id"] % 4 == 0) | (rows["id"] < 5)]
    got = scenarios._figures(pd.concat([rows.assign(asks=False), asked.assign(asks=True)]), _packed(asked, 0.0)).set_index("scenario")
    want = _scores(rows, asked).groupby("scenario")["score"].agg(["count", "sum", "max"])
    assert got["queries"].to_dict() == want["count"].to_dict()
    assert np.allclose(got["total"], want["sum"].loc[got.index], atol=1e-9) and np.allclose(got["best"], want["max"].loc[got.index], atol=1e-12)


def test_the_best_query_of_a_scenario_is_looked_for_beside_its_ranges(met):
    share = []
    for n in (3000, 12_000):
        rows = _rows(n, 1)
        asked = rows[rows["id"] % 4 == 0]
        met.clear()
        scenarios._figures(pd.concat([rows.assign(asks=False), asked.assign(asks=True)]), _packed(asked, 0.0))
        share.append(sum(met) / (len(asked) * rows["scenario"].nunique()))
    assert share[1] < 0.1 and share[1] < share[0] / 2


def test_scenarios_that_cannot_be_among_the_best_do_not_meet_a_query(met):
    share = []
    for n in (3000, 12_000):
        rows = _rows(n, 2).assign(asks=False)
        asked = rows[rows["id"] % 4 == 0]
        kinds = asked[list(scenarios.REST)].drop_duplicates().to_numpy()
        floor = scenarios._leaders(rows, kinds, 6).groupby(list(scenarios.REST))["score"].min().min()
        met.clear()
        scenarios._found(pd.concat([rows, asked.assign(asks=True)]), _packed(asked, floor), 6)
        share.append(sum(met) / (len(asked) * rows["scenario"].nunique()))
    assert share[1] < 0.02 and share[1] < share[0]


@pytest.mark.parametrize("size, kinds", [(3, 16_384), (100, 16_384), (6, 3)])  # more kinds than 3: all pairs
def test_matches_of_scenarios_against_all_pairs(spark, monkeypatch, size, kinds):
    monkeypatch.setattr(scenarios, "KINDS", kinds)
    rows = _rows(600, size, size)
    rows.loc[rows.index % 50 == 0, "scenario"] = 10_000 + rows["id"] % 7  # scores that are equal go by scenario
    own = spark.createDataFrame(rows.astype({"is_bullish": bool}))
    asked = rows[rows["id"] % 4 == 0]
    for least in (0.3, 0.8):
        want = _scores(rows, asked)
        want = want[want["score"] >= least].assign(key=lambda df: -df["score"].round(9)).sort_values(["query_id", "key", "scenario"]).groupby("query_id").head(5)
        got = memory.scenario_matches(own.where("id % 4 = 0"), own, 5, least, 65_536, 70).orderBy("query_id", "rank").toPandas()
        assert got[["query_id", "scenario"]].to_numpy().tolist() == want[["query_id", "scenario"]].to_numpy().tolist() and np.allclose(got["score"], want["score"], atol=1e-12)


def test_an_id_in_many_scenarios_is_left_out_of_each(spark):
    rows = _rows(300, 4)
    rows = pd.concat([rows, *[rows[:40].assign(scenario=lambda df, k=k: df["scenario"] + 1000 * k) for k in (1, 2, 3, 4, 5, 6, 7)]])
    asked = rows.drop_duplicates("id")[::3]
    queries, own = (spark.createDataFrame(df.astype({"is_bullish": bool})) for df in (asked, rows))
    want = _scores(rows, asked).assign(key=lambda df: -df["score"].round(9)).sort_values(["query_id", "key", "scenario"]).groupby("query_id").head(5)
    got = memory.scenario_matches(queries, own, 5).orderBy("query_id", "rank").toPandas()
    assert got[["query_id", "scenario"]].to_numpy().tolist() == want[["query_id", "scenario"]].to_numpy().tolist() and np.allclose(got["score"], want["score"], atol=1e-12)


def test_no_queries_and_features_without_a_value(spark):
    own = spark.createDataFrame(_rows(60, 5).astype({"is_bullish": bool}))
    assert memory.scenario_matches(own.where("id < 0"), own, 5).count() == 0 and memory.scenario_summary(own.where("id < 0"), own).count() == 0
    gap = own.selectExpr("id", "scenario", "CASE WHEN id <> 7 THEN range_pct END AS range_pct", "body_pct", "is_bullish", "close_position", "volatility")
    fine = gap.where("id <> 7")
    assert not scenarios.add_up(gap, fine)[0] and not scenarios.add_up(fine, gap)[0] and scenarios.add_up(fine, fine) == (True, 59)
