"""Market memory: snapshot features, scans of stored events, and matching of scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scenarios
from tidemark.operators.scenarios import COLUMNS as _COLUMNS
from tidemark.operators.scenarios import WEIGHTS


def snapshot_features(bars: DataFrame) -> DataFrame:
    """Range in percent of the close, body as a share of the range, where the close lies in it, and direction."""
    span = F.col("high") - F.col("low")
    share = lambda top, empty: F.when(span > 0, top / span).otherwise(empty)
    return bars.withColumns({"range_pct": F.when(F.col("close") != 0, span / F.col("close") * 100).otherwise(0.0), "body_pct": share(F.abs(F.col("close") - F.col("open")), 0.0), "close_position": share(F.col("close") - F.col("low"), 0.5), "is_bullish": F.col("close") > F.col("open"), "is_bearish": F.col("close") < F.col("open")})


def severe(calendar: DataFrame) -> DataFrame:
    return calendar.where(F.lower("severity").isin("high", "critical"))


def of_country(calendar: DataFrame, country: str) -> DataFrame:
    return calendar.where(F.upper("country") == country.upper())


def of_asset(events: DataFrame, symbol: str) -> DataFrame:
    return events.where(F.col("symbol") == symbol)


def in_range(events: DataFrame, start, end) -> DataFrame:
    """Events from ``start`` to ``end``, both included; None leaves a side open."""
    own = events.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start is not None else events
    return own.where(F.col("ts") <= F.lit(end).cast("timestamp")) if end is not None else own


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each symbol, equal times by event_id."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), "event_id")
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def condition_values(events: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values of each field, as text: field, value."""
    long = events.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    return long.where("value is not null").distinct()


def similarity(q: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> np.ndarray:
    """Similarity of each query snapshot (rows) to each stored one (columns), within [0, 1]."""
    gap = lambda c: np.abs(q[c][:, None] - s[c][None, :])
    parts = {
        "range": 1 - np.clip(gap("range_pct") / 10, 0, 1), "body": 1 - gap("body_pct"), "trend": (gap("is_bullish") == 0).astype(float),
        "position": 1 - gap("close_position"), "volatility": 1 - np.clip(gap("volatility") / 5, 0, 1),
    }
    return np.clip(sum(WEIGHTS[k] * v for k, v in parts.items()), 0, 1)


#: Cells of queries and snapshots that a task compares at once.
CELLS = 2_000_000
_REST = ("body_pct", "is_bullish", "close_position", "volatility")


def _compared(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, scenarios, and sums of similarity and numbers of snapshots (queries x scenarios) of one block, few
    queries at a time; a query's own snapshots are left out.

    The parts of similarity add up, so a scenario's sum over all but the range is taken once for each distinct kind of
    query, and the range counts only within ten of the query's. Where a part falls below 0, pairs are taken one by one.
    """
    s = rows[~rows["asks"]].sort_values("range_pct", kind="stable")
    q = rows[rows["asks"]].sort_values([*_REST, "range_pct"], kind="stable")
    if q.empty or s.empty:
        return
    scenario, names = pd.factorize(s["scenario"], sort=True, use_na_sentinel=False)
    order = np.argsort(scenario, kind="stable")
    first, size = np.searchsorted(scenario[order], np.arange(len(names))), np.bincount(scenario)
    have, ask = ({c: df[c].to_numpy(float) for c in _COLUMNS} for df in (s, q))
    ids = q["id"].to_numpy()
    own = pd.DataFrame({"id": ids, "q": np.arange(len(q))}).merge(pd.DataFrame({"id": s["id"].to_numpy(), "s": np.arange(len(s))}), on="id").sort_values("q")
    own_q, own_s = own["q"].to_numpy(), own["s"].to_numpy()
    spread = [np.r_[have[c], ask[c]] for c in ("body_pct", "close_position")]
    adds_up = all(np.ptp(v) <= 1 for v in spread) and all(np.isfinite(v).all() for side in (have, ask) for v in side.values())
    alike = lambda a, b: similarity(a, b) if not adds_up else similarity({**a, "range_pct": np.zeros_like(a["range_pct"])}, {**b, "range_pct": np.full_like(b["range_pct"], 10.0)})
    by_scenario = {c: v[order] for c, v in have.items()}
    kinds = np.stack([ask[c] for c in _REST], axis=1)
    step, last, line = max(1, CELLS // len(s)), None, None
    for lo in range(0, len(q), step):
        hi = min(lo + step, len(q))
        part = {c: v[lo:hi] for c, v in ask.items()}
        if adds_up:
            total = np.empty((hi - lo, len(names)))
            for k, kind in enumerate(kinds[lo:hi]):
                if last is None or (kind != last).any():
                    last, line = kind, np.add.reduceat(alike({c: v[k : k + 1] for c, v in part.items()}, by_scenario)[0], first)
                total[k] = line
            _add_range(total, scenario, have["range_pct"], part["range_pct"])
        else:
            total = np.add.reduceat(alike(part, by_scenario), first, axis=1)
        n = np.broadcast_to(size, total.shape)
        a, b = np.searchsorted(own_q, [lo, hi])
        if a < b:
            i, j, n = own_q[a:b], own_s[a:b], n.copy()
            self = np.array([similarity({c: v[x : x + 1] for c, v in ask.items()}, {c: v[y : y + 1] for c, v in have.items()})[0, 0] for x, y in zip(i, j)])
            np.subtract.at(total, (i - lo, scenario[j]), self)
            np.subtract.at(n, (i - lo, scenario[j]), 1)
        yield ids[lo:hi], np.asarray(names), total, n


def _add_range(total: np.ndarray, scenario: np.ndarray, stored: np.ndarray, asked: np.ndarray) -> None:
    """Adds the range's part: ``stored`` ranges in order meet the asked ones within ten of them."""
    order = np.argsort(asked, kind="stable")
    ranges = asked[order]
    lo, hi = np.searchsorted(stored, [ranges[0] - 10, ranges[-1] + 10])
    stored, scenario = stored[lo:hi], scenario[lo:hi]
    start = np.searchsorted(ranges, stored - 10)
    met = np.searchsorted(ranges, stored + 10, "right") - start
    if not met.sum():
        return
    which = np.repeat(np.arange(len(stored)), met)
    at = np.arange(len(which)) - np.repeat(np.cumsum(met) - met, met) + start[which]
    part = WEIGHTS["range"] * (1 - np.clip(np.abs(ranges[at] - stored[which]) / 10, 0, 1))
    total += np.bincount(order[at] * total.shape[1] + scenario[which], part, total.size).reshape(total.shape)


def _dealt(queries: DataFrame, snapshots: DataFrame, block: int, asks_block: int) -> tuple[DataFrame, DataFrame | None]:
    """Query rows and snapshots side by side in numbered blocks (i of snapshots, j of queries): whole scenarios in each,
    and, if there are any, scenarios of more than ``block`` snapshots, each cut into blocks of its own."""
    count = snapshots.count()
    bases, asks = max(1, -(-count // block), min(32, count // 4096)), max(1, -(-queries.count() // asks_block))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    big, start = [], bases
    for r in snapshots.groupBy("scenario").count().where(F.col("count") > block).collect():
        parts = -(-r["count"] // block)
        big.append((r["scenario"], start, parts))
        start += parts
    kind = dict(snapshots.dtypes)
    columns = [F.col(c).cast("double").alias(c) for c in _COLUMNS]
    own = snapshots.select("id", "scenario", *columns)
    i = place("scenario", F.lit(bases))
    if big:
        table = F.broadcast(snapshots.sparkSession.createDataFrame(big, f"_scenario {kind['scenario']}, _start int, _parts int"))
        own = own.join(table, F.col("scenario").eqNullSafe(F.col("_scenario")), "left")
        i = F.when(F.col("_parts").isNull(), i).otherwise(F.col("_start") + place("id", F.col("_parts")))
    own = own.select("id", "scenario", *_COLUMNS, F.lit(False).alias("asks"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("j"))
    asked = queries.select("id", F.lit(None).cast(kind["scenario"]).alias("scenario"), *columns, F.lit(True).alias("asks"), place("id", F.lit(asks)).alias("j"))
    side = lambda lo, hi: own.where(F.col("i").between(lo, hi)).unionByName(asked.withColumn("i", F.explode(F.sequence(F.lit(lo), F.lit(hi)))))
    return side(0, bases - 1), side(bases, start - 1) if big else None


def _sums(dealt: DataFrame, kind: dict[str, str]) -> DataFrame:
    """query_id, scenario, score, n from blocks, a row for each query and scenario of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, names, total, n in _compared(pd.concat(list(batches))):
            a, b = np.nonzero(n)
            yield pd.DataFrame({"query_id": ids[a], "scenario": names[b], "total": total[a, b], "n": n[a, b]})

    found = dealt.groupBy("i", "j").applyInPandas(run, f"query_id {kind['id']}, scenario {kind['scenario']}, total double, n long")
    return found.groupBy("query_id", "scenario").agg((F.sum("total") / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def scenario_scores(queries: DataFrame, snapshots: DataFrame, block: int = 65_536, asks_block: int = 65_536) -> DataFrame:
    """Mean similarity of each query snapshot to the snapshots of each scenario, its own left out: query_id, scenario,
    score, n. Both: id and the feature columns; ``snapshots`` has ``scenario`` besides.

    The query set meets every snapshot, as the score asks. Snapshots are dealt into blocks of whole scenarios, a scenario
    of more than ``block`` of them into blocks of its own; a task holds one block of either side and hands on few
    queries' sums at a time. The result has a row for each query and scenario; where only the best scenarios of a query
    or the figures of a scenario are asked for, :func:`scenario_matches` and :func:`scenario_summary` keep them inside
    the tasks.
    """
    kind = dict(snapshots.dtypes)
    whole, cut = _dealt(queries, snapshots, block, asks_block)
    found = _sums(whole, kind)
    return found if cut is None else found.unionByName(_sums(cut, kind))


def _divided(snapshots: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Snapshots of scenarios of at most ``block`` of them, and those of larger ones, if there are any."""
    large = snapshots.groupBy("scenario").count().where(F.col("count") > block).collect()
    if not large:
        return snapshots, None
    table = F.broadcast(snapshots.sparkSession.createDataFrame([(r["scenario"],) for r in large], f"_scenario {dict(snapshots.dtypes)['scenario']}"))
    of = lambda how: snapshots.join(table, F.col("scenario").eqNullSafe(F.col("_scenario")), how)
    return of("left_anti"), of("left_semi")


def scenario_summary(queries: DataFrame, snapshots: DataFrame, block: int = 262_144, asks_block: int = 524_288) -> DataFrame:
    """Of each scenario the number of queries it has a score for, and the mean and best of these scores: scenario,
    queries, mean, best (to 14 decimals, as sums differ in the last ones). Ids of queries are unique. A task returns one
    row a scenario.

    Where parts add up (:func:`scenarios.add_up`), sums come from running totals over the queries, and only queries next
    to a scenario's ranges can be its best; else, and for scenarios of more than ``block`` snapshots, all pairs are taken.
    """
    kind = dict(snapshots.dtypes)
    adds_up, count = scenarios.add_up(queries, snapshots)
    if adds_up:
        small, large = _divided(snapshots, block)
        found = scenarios.summary(queries, small, count, block, asks_block)
        cut = None if large is None else _dealt(queries, large, block, min(asks_block, 65_536))[1]
    else:
        whole, cut = _dealt(queries, snapshots, min(block, 65_536), min(asks_block, 65_536))
        found = whole.groupBy("i", "j").applyInPandas(_summed, f"scenario {kind['scenario']}, queries long, total double, best double")
    if cut is not None:
        found = found.unionByName(_sums(cut, kind).select("scenario", F.lit(1).cast("long").alias("queries"), F.col("score").alias("total"), F.col("score").alias("best")))
    return found.groupBy("scenario").agg(F.sum("queries").alias("queries"), (F.sum("total") / F.sum("queries")).alias("mean"), F.round(F.max("best"), 14).alias("best"))


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    names, count, total, best = [], 0, 0.0, -np.inf
    for _, names, sums, n in _compared(rows):
        some = n > 0
        score = np.where(some, sums / np.maximum(n, 1), -np.inf)
        count, best = count + some.sum(0), np.maximum(best, score.max(0))
        total = total + np.where(some, score, 0.0).sum(0)
    own = pd.DataFrame({"scenario": names, "queries": count, "total": total, "best": best})
    return own[own["queries"] > 0]


def scenario_matches(queries: DataFrame, snapshots: DataFrame, n: int, least: float = 0.0, block: int = 262_144, asks_block: int = 524_288) -> DataFrame:
    """The ``n`` best scenarios of each query, as :func:`best_scenarios` of all scores. Ids of queries are unique.

    Where parts add up (:func:`scenarios.add_up`) and queries have few kinds, only scenarios that can be among the best
    meet a query (:func:`scenarios.matches`); else, and for scenarios of more than ``block`` snapshots, all pairs are
    taken, and a task keeps ``n`` of its block for each query.
    """
    kind = dict(snapshots.dtypes)
    adds_up, count = scenarios.add_up(queries, snapshots)
    small, large = _divided(snapshots, block) if adds_up else (snapshots, None)
    found = scenarios.matches(queries, small, n, least, count, block, asks_block) if adds_up else None
    if found is not None:
        cut = None if large is None else _dealt(queries, large, block, min(asks_block, 65_536))[1]
    else:
        whole, cut = _dealt(queries, snapshots, min(block, 65_536), min(asks_block, 65_536))
        found = whole.groupBy("i", "j").applyInPandas(lambda rows: _kept(rows, n, least), f"query_id {kind['id']}, scenario {kind['scenario']}, score double")
    if cut is not None:
        found = found.unionByName(_sums(cut, kind).select("query_id", "scenario", "score"))
    return best_scenarios(found, n, least)


def _kept(rows: pd.DataFrame, n: int, least: float) -> pd.DataFrame:
    out = []
    for ids, names, sums, size in _compared(rows):
        score = np.where(size > 0, sums / np.maximum(size, 1), -np.inf)
        width = max(1, score.shape[1] // 64)  # the n-th best of the groups' best is no better than the n-th best
        tops = np.maximum.reduceat(score, np.arange(0, score.shape[1], width), axis=1)
        floor = np.partition(tops, -n, axis=1)[:, -n] if tops.shape[1] >= n else np.full(len(score), -np.inf)
        a, b = np.nonzero((score >= floor[:, None] - 1e-8) & (score >= least))
        got = pd.DataFrame({"a": a, "b": b, "score": score[a, b]})
        got["key"] = got["score"].round(9)
        got = got.sort_values(["a", "key", "b"], ascending=[True, False, True]).groupby("a", sort=False).head(n)
        out.append(pd.DataFrame({"query_id": ids[got["a"]], "scenario": names[got["b"]], "score": got["score"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "scenario": [], "score": []})


def best_scenarios(scores: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """The ``n`` best scenarios of each query with a score of at least ``least``; scores equal to nine decimals go by
    scenario."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "scenario")
    return scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
