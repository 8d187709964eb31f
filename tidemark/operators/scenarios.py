"""Scores of scenarios without a cell for each query and scenario.

Each part of the similarity of two snapshots is a tent over the gap between them: 1 where they are equal, falling to 0 at
a width. So a scenario's score is its mean over a query's four parts but the range, which is one line for each distinct
kind of query, and the mean of tents over the range, which peaks at the scenario's own ranges and is 0 away from them.
Queries are taken as profiles, the distinct values of their features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Weights of the parts of snapshot similarity, and gaps at which a part is 0.
WEIGHTS = {"range": 0.25, "body": 0.20, "trend": 0.25, "position": 0.15, "volatility": 0.15}
COLUMNS = ("range_pct", "body_pct", "is_bullish", "close_position", "volatility")
REST = COLUMNS[1:]
_WEIGHT = dict(zip(COLUMNS, WEIGHTS.values()))
_WIDTH = {"range_pct": 10.0, "body_pct": 1.0, "is_bullish": 1.0, "close_position": 1.0, "volatility": 5.0}

#: Numbers that a task holds in one array of a step, profiles in one packed row, and kinds of queries up to which lines
#: are kept by kind for :func:`matches`.
CELLS = 2_000_000
PACK = 16_384
KINDS = 16_384
#: Scores less than this below a bound are still looked at, as sums differ in their last digits.
_SLACK = 1e-8


def _tent(gap: np.ndarray, width: float) -> np.ndarray:
    return np.maximum(1 - np.abs(gap) / width, 0)


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``count`` places from ``first`` on, for each entry: the entry, and the place."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def _pieces(count: np.ndarray) -> Iterator[slice]:
    """Slices of about CELLS places, one entry at least."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        yield slice(lo, hi)
        lo = hi


def _leading(group: np.ndarray, code: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of each group; scores equal to nine decimals go by code."""
    order = np.lexsort((code, -score.round(9), group))
    own = group[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < n]


class Profiles:
    """Distinct queries of one block in order of kind (all features but the range) and range."""

    def __init__(self, packed: pd.DataFrame):
        parts = [pickle.loads(v) for v in packed.sort_values("part")["data"]]
        rest = np.concatenate([kinds[kind] for kinds, kind, _, _, _ in parts])
        floor = np.concatenate([floors[kind] for _, kind, floors, _, _ in parts])
        self.range, self.count = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        new = np.r_[True, (rest[1:] != rest[:-1]).any(axis=1)]
        self.kinds, self.floor, self.kind = rest[new], floor[new], np.cumsum(new) - 1
        self.start = np.flatnonzero(new)
        self.end = np.r_[self.start[1:], len(rest)]
        self.levels = np.unique(self.range)
        self.key = self.kind * (len(self.levels) + 1) + np.searchsorted(self.levels, self.range)

    def place(self, rows: pd.DataFrame) -> np.ndarray:
        """The profile of each query of ``rows``, which is in this block."""
        kinds = pd.DataFrame(self.kinds, columns=list(REST)).assign(_kind=np.arange(len(self.kinds)))
        kind = rows[list(REST)].merge(kinds, on=list(REST), how="left")["_kind"].to_numpy()
        return np.searchsorted(self.key, kind * (len(self.levels) + 1) + np.searchsorted(self.levels, rows["range_pct"].to_numpy()))


class Scenarios:
    """Snapshots of whole scenarios in order of scenario and range, and the asked ones among them."""

    def __init__(self, rows: pd.DataFrame):
        code, self.names = pd.factorize(rows["scenario"], sort=True, use_na_sentinel=False)
        asks = rows["asks"].to_numpy(bool)
        self.asked = rows[asks].assign(code=code[asks]).drop_duplicates(["id", "code"]).reset_index(drop=True)
        s, code = rows[~asks], code[~asks]
        order = np.lexsort((s["range_pct"].to_numpy(), code))
        self.code, self.ids = code[order], s["id"].to_numpy()[order]
        self.value = {c: s[c].to_numpy(float)[order] for c in COLUMNS}
        self.range = self.value["range_pct"]
        self.size = np.bincount(code, minlength=len(self.names))
        self.first = np.cumsum(self.size) - self.size
        self.levels = np.unique(self.range)
        self.key = self._key(self.code, self.range)

    def _key(self, code: np.ndarray, value: np.ndarray, side: str = "left") -> np.ndarray:
        return code * (len(self.levels) + 1) + np.searchsorted(self.levels, value, side)

    def within(self, code: np.ndarray, value: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last (not included) snapshot of scenario ``code`` within ``gap`` of ``value``."""
        return np.searchsorted(self.key, self._key(code, value - gap)), np.searchsorted(self.key, self._key(code, value + gap, "right"))

    def tents(self, code: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sums of the range's part over the snapshots of scenario ``code``, for a query's range ``value``."""
        lo, hi = self.within(code, value, _WIDTH["range_pct"])
        out = np.empty(len(code))
        for p in _pieces(hi - lo):
            which, at = _ragged(lo[p], (hi - lo)[p])
            out[p] = np.bincount(which, _tent(value[p][which] - self.range[at], _WIDTH["range_pct"]), p.stop - p.start)
        return out

    def peaks(self) -> np.ndarray:
        """The highest sum of the range's part in each scenario, which it has at a range of its own."""
        return np.maximum.reduceat(self.tents(self.code, self.range), self.first)

    def lines(self, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Scores without the range (kinds x scenarios), few kinds at a time, with the number of the first kind."""
        step = max(1, CELLS // len(self.names))
        for lo in range(0, len(kinds), step):
            total = 0.0
            for c, asked in zip(REST, kinds[lo : lo + step].T):
                values, at = np.unique(asked, return_inverse=True)
                part = np.stack([np.add.reduceat(_tent(v - self.value[c], _WIDTH[c]), self.first) for v in values])
                total = total + _WEIGHT[c] * part[at]
            yield lo, total / self.size

    def against_own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each asked snapshot and its scenario: the score by all snapshots, and the score by all but the query's own
        and the number of those."""
        q, code = self.asked, self.asked["code"].to_numpy()
        ids, asked = q["id"].to_numpy(), {c: q[c].to_numpy(float) for c in COLUMNS}
        whole, rest, n = (np.zeros(len(q)) for _ in range(3))
        for p in _pieces(self.size[code]):
            which, at = _ragged(self.first[code[p]], self.size[code[p]])
            like = sum(_WEIGHT[c] * _tent(asked[c][p][which] - self.value[c][at], _WIDTH[c]) for c in COLUMNS)
            other = self.ids[at] != ids[p][which]
            add = lambda v: np.bincount(which, v, p.stop - p.start)  # noqa: B023, E731
            whole[p], rest[p], n[p] = add(like), add(like * other), add(other.astype(float))
        return whole / self.size[code], rest / np.maximum(n, 1), n


def _sum_of_tents(values: np.ndarray, count: np.ndarray, width: float, at: np.ndarray) -> np.ndarray:
    """Sums of ``count`` tents over ``values``, at each place."""
    values, which = np.unique(values, return_inverse=True)
    n = np.r_[0, np.cumsum(np.bincount(which, count))]
    weighted = np.r_[0, np.cumsum(np.bincount(which, count) * values)]
    lo, mid, hi = (np.searchsorted(values, v, side) for v, side in ((at - width, "left"), (at, "left"), (at + width, "right")))
    below = (n[mid] - n[lo]) * (1 - at / width) + (weighted[mid] - weighted[lo]) / width
    above = (n[hi] - n[mid]) * (1 + at / width) - (weighted[hi] - weighted[mid]) / width
    return below + above


def _best(own: Scenarios, asked: Profiles, shut: np.ndarray) -> np.ndarray:
    """The best score of each scenario over all profiles but those in ``shut`` (sorted scenario * profiles + profile).

    Between peaks the sum of tents only falls or only rises towards one, so of a kind's profiles those next to a peak are
    enough; kinds that cannot reach the best score found are left out.
    """
    weight, best = _WEIGHT["range_pct"], np.full(len(own.names), -np.inf)
    spare = np.bincount(shut // len(asked.range), minlength=len(own.names))
    centre = np.searchsorted(asked.levels, own.range)
    many = asked.end - asked.start

    def meet(code: np.ndarray, line: np.ndarray, at: np.ndarray) -> None:
        key = code * len(asked.range) + at
        if len(shut):
            free = shut[np.minimum(np.searchsorted(shut, key), len(shut) - 1)] != key
            code, line, at = code[free], line[free], at[free]
        np.maximum.at(best, code, line + weight * own.tents(code, asked.range[at]) / own.size[code])

    def look(code: np.ndarray, kind: np.ndarray, line: np.ndarray) -> None:
        width = 2 * (spare[code] + 1)
        dense = own.size[code] * width >= many[kind]
        c, k, v = code[dense], kind[dense], line[dense]
        for p in _pieces(many[k]):
            which, at = _ragged(asked.start[k[p]], many[k[p]])
            meet(c[p][which], v[p][which], at)
        for t in np.unique(spare[code[~dense]]):
            some = ~dense & (spare[code] == t)
            c, k, v = code[some], kind[some], line[some]
            for p in _pieces(own.size[c] * 2 * (t + 1)):
                which, at = _ragged(own.first[c[p]], own.size[c[p]])
                near = np.searchsorted(asked.key, k[p][which] * (len(asked.levels) + 1) + centre[at])[:, None] + np.arange(-1 - t, t + 1)
                which = np.broadcast_to(which[:, None], near.shape)
                fits = (near >= asked.start[k[p][which]]) & (near < asked.end[k[p][which]])
                meet(c[p][which[fits]], v[p][which[fits]], near[fits])

    top, first = np.full(len(own.names), -np.inf), np.zeros(len(own.names), int)
    for lo, line in own.lines(asked.kinds):
        most = line.argmax(axis=0)
        value = line[most, np.arange(len(most))]
        first, top = np.where(value > top, lo + most, first), np.maximum(value, top)
    look(np.arange(len(top)), first, top)
    reach = weight * own.peaks() / own.size + _SLACK
    for lo, line in own.lines(asked.kinds):
        k, c = np.nonzero(line + reach > best)
        other = lo + k != first[c]
        look(c[other], lo + k[other], line[k[other], c[other]])
    return best


def _figures(rows: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    """Of each scenario of a block: queries with a score, and the sum and best of these scores."""
    if packed.empty or rows["asks"].all():
        return pd.DataFrame({"scenario": [], "queries": [], "total": [], "best": []})
    own, asked = Scenarios(rows), Profiles(packed)
    parts = sum(_WEIGHT[c] * _sum_of_tents(asked.range if c == "range_pct" else asked.kinds[asked.kind, REST.index(c)], asked.count, _WIDTH[c], own.value[c]) for c in COLUMNS)
    total = np.add.reduceat(parts, own.first) / own.size
    code = own.asked["code"].to_numpy()
    whole, rest, n = own.against_own()
    some = n > 0
    key, times = np.unique(code * len(asked.range) + asked.place(own.asked), return_counts=True)
    best = _best(own, asked, key[times >= asked.count[key % len(asked.range)]])
    np.maximum.at(best, code[some], rest[some])
    queries = asked.count.sum() - np.bincount(code[~some], minlength=len(own.names))
    total += np.bincount(code, np.where(some, rest, 0) - whole, len(own.names))
    out = pd.DataFrame({"scenario": own.names, "queries": queries, "total": total, "best": best})
    return out[out["queries"] > 0]


def _leaders(rows: pd.DataFrame, kinds: np.ndarray, n: int) -> pd.DataFrame:
    """The ``n`` scenarios of a block with the best score without the range, for each kind."""
    own, out = Scenarios(rows), []
    for lo, line in own.lines(kinds):
        value = line.round(9)
        if value.shape[1] > n:
            k, c = np.nonzero(value >= np.partition(value, -n, axis=1)[:, -n][:, None])
        else:
            k, c = (v.ravel() for v in np.indices(value.shape))
        got = _leading(k, c, line[k, c], n)
        out.append((lo + k[got], c[got], line[k[got], c[got]]))
    k, c, score = (np.concatenate(v) for v in zip(*out))
    return pd.DataFrame({**dict(zip(REST, kinds[k].T)), "scenario": own.names[c], "score": score})


def _reaching(own: Scenarios, asked: Profiles, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Profiles, scenarios with snapshots near in range, and scores that reach the floor of the profile's kind; the ``n``
    best of each profile.

    A profile is looked at from the scenario's nearest range. As no snapshot adds more than the nearest, and those more
    than two widths off add nothing, the floor bounds how far that range may be.
    """
    width, weight = _WIDTH["range_pct"], _WEIGHT["range_pct"]
    lo, hi = own.within(own.code, own.range, 2 * width)
    crowd, peak = hi - lo, own.peaks()
    edge = np.r_[-np.inf, (own.range[1:] + own.range[:-1]) / 2, np.inf]
    left, right = edge[:-1].copy(), edge[1:].copy()
    left[own.first], right[own.first + own.size - 1] = -np.inf, np.inf
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for base, line in own.lines(asked.kinds):
        need = (asked.floor[base : base + len(line), None] - _SLACK - line) * own.size / weight
        for row in np.flatnonzero((need <= peak).any(axis=1)):
            k = base + row
            c = np.flatnonzero(need[row] <= peak)
            which, at = _ragged(own.first[c], own.size[c])
            reach = width * (1 - np.maximum(need[row, c], 0)[which] / crowd[at])
            which, at, reach = which[reach >= 0], at[reach >= 0], reach[reach >= 0]
            r = asked.range[asked.start[k] : asked.end[k]]
            lo = np.maximum(np.searchsorted(r, own.range[at] - reach), np.searchsorted(r, left[at]))
            hi = np.minimum(np.searchsorted(r, own.range[at] + reach, "right"), np.searchsorted(r, right[at]))
            met = np.maximum(hi - lo, 0)
            found = []
            for p in _pieces(met):
                of, place = _ragged(lo[p], met[p])
                code = c[which[p][of]]
                score = line[row, code] + weight * own.tents(code, r[place]) / own.size[code]
                place, code, score = (v[score >= asked.floor[k] - _SLACK] for v in (place, code, score))
                got = _leading(place, code, score, n)
                found.append((place[got], code[got], score[got]))
            if found:
                place, code, score = (np.concatenate(v) for v in zip(*found))
                got = _leading(place, code, score, n)
                out.append((place[got] + asked.start[k], code[got], score[got]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _found(rows: pd.DataFrame, packed: pd.DataFrame, n: int) -> pd.DataFrame:
    """Rows of :func:`_reaching`, and (with the query's id) the scores of asked snapshots' own scenarios."""
    if packed.empty or rows["asks"].all():
        return pd.DataFrame({c: [] for c in ("query_id", *COLUMNS, "scenario", "score")})
    own, asked = Scenarios(rows), Profiles(packed)
    at, code, score = _reaching(own, asked, n)
    near = pd.DataFrame({"query_id": pd.Series([None] * len(at), dtype=object), "range_pct": asked.range[at], **dict(zip(REST, asked.kinds[asked.kind[at]].T)), "scenario": own.names[code], "score": score})
    _, rest, n = own.against_own()
    self = own.asked[["id", *COLUMNS]].rename(columns={"id": "query_id"}).astype({"query_id": object})
    self = self.assign(scenario=own.names[own.asked["code"].to_numpy()], score=np.where(n > 0, rest, -1.0))
    return pd.concat([d for d in (near, self) if len(d)] or [near])


def add_up(queries: DataFrame, snapshots: DataFrame) -> tuple[bool, int]:
    """Whether all features are finite and no part of a similarity falls below 0, so that parts are tents; and the number
    of snapshots."""
    low, high, fine, count = [], [], True, 0
    for df in (queries, snapshots):
        value = [F.col(c).cast("double") for c in COLUMNS]
        finite = [~F.isnan(v) & (F.abs(v) < float("inf")) for v in value]
        row = df.agg(F.count("*"), *[F.count_if(v) for v in finite], *[F.min(F.col(c)) for c in ("body_pct", "close_position")], *[F.max(F.col(c)) for c in ("body_pct", "close_position")]).head()
        count = row[0]
        fine = fine and all(v == count for v in row[1:6]) and dict(df.dtypes)["is_bullish"] == "boolean"
        low.append(row[6:8])
        high.append(row[8:10])
    if not fine or None in [*low[0], *low[1]]:
        return False, count
    return all(max(float(h) for h in hi) - min(float(v) for v in lo) <= 1 for lo, hi in zip(zip(*low), zip(*high))), count


def _values() -> list:
    return [(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in COLUMNS]  # -0.0 becomes 0.0


def _profiles(queries: DataFrame) -> DataFrame:
    return queries.select(*_values()).groupBy(*COLUMNS).agg(F.count("*").alias("n"))


def _dealt(queries: DataFrame | None, snapshots: DataFrame, bases: int, asks: int) -> DataFrame:
    """Snapshots in numbered blocks of whole scenarios (i), once for each block of profiles (j), and each asked snapshot
    in its scenario's block and its profile's."""
    place = F.pmod(F.xxhash64("scenario"), F.lit(bases)).cast("int").alias("i")
    own = snapshots.select("id", "scenario", *_values())
    rows = own.select("*", F.lit(False).alias("asks"), place, F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("j"))
    if queries is not None:
        asked = queries.select("id", *_values()).join(own.select("id", "scenario"), "id")
        rows = rows.unionByName(asked.select("id", "scenario", *COLUMNS, F.lit(True).alias("asks"), place, _part(asks)))
    return rows.repartition(bases * asks, "i", "j")


def _part(asks: int):
    return F.pmod(F.xxhash64(*COLUMNS), F.lit(asks)).cast("int").alias("j")


def _packed(profiles: DataFrame, bases: int, asks: int) -> DataFrame:
    """Profiles (with floor) as few packed rows, in each block of snapshots."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*REST, "range_pct"], kind="stable")
        out = []
        for lo in range(0, len(rows), PACK):
            part = rows[lo : lo + PACK]
            rest = part[list(REST)].to_numpy()
            new = np.r_[True, (rest[1:] != rest[:-1]).any(axis=1)]
            out.append(pickle.dumps((rest[new], np.cumsum(new) - 1, part["floor"].to_numpy()[new], part["range_pct"].to_numpy(), part["n"].to_numpy()), protocol=5))
        return pd.DataFrame({"j": rows["j"].iloc[0], "part": range(len(out)), "data": out})

    made = stored(profiles.withColumn("j", _part(asks)).groupBy("j").applyInPandas(run, "j int, part int, data binary"))
    return made.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bases - 1)))).repartition(bases * asks, "i", "j")


def blocks(count: int, block: int) -> int:
    return max(1, -(-count // block), min(32, count // 4096))


def summary(queries: DataFrame, snapshots: DataFrame, count: int, block: int, asks_block: int) -> DataFrame:
    """scenario, queries, total, best: one row a scenario and block of profiles."""
    profiles = _profiles(queries).withColumn("floor", F.lit(0.0))
    bases, asks = blocks(count, block), max(1, -(-profiles.count() // asks_block))
    rows, packed = _dealt(queries, snapshots, bases, asks), _packed(profiles, bases, asks)
    kind = dict(snapshots.dtypes)["scenario"]
    return rows.groupBy("i", "j").cogroup(packed.groupBy("i", "j")).applyInPandas(_figures, f"scenario {kind}, queries long, total double, best double")


def matches(queries: DataFrame, snapshots: DataFrame, n: int, least: float, count: int, block: int, asks_block: int) -> DataFrame | None:
    """query_id, scenario, score with the ``n`` best scenarios of each query of at least ``least`` among them; None
    where there are no queries or more than KINDS kinds of them.

    The best scenarios without the range give each kind a floor: they alone may be best where no range is near; others
    must reach the floor by it. Scores are rounded to 14 decimals, as sums differ in the last ones.
    """
    profiles = _profiles(queries)
    kinds = np.array([tuple(r) for r in profiles.select(*REST).distinct().limit(KINDS + 1).collect()]).reshape(-1, len(REST))
    if not 0 < len(kinds) <= KINDS:
        return None
    types = dict(snapshots.dtypes)
    bases, asks = blocks(count, block), max(1, -(-profiles.count() // asks_block))
    features, extra = ", ".join(f"{c} double" for c in REST), 1
    while True:
        m = n + extra  # a query's own scenarios are scored without it, so they may leave the others' list
        lead = _dealt(None, snapshots, bases, 1).groupBy("i").applyInPandas(lambda rows: _leaders(rows, kinds, m), f"{features}, scenario {types['scenario']}, score double")
        w = Window.partitionBy(*REST).orderBy(F.desc(F.round("score", 9)), "scenario")
        lead = stored(lead.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= m).drop("_rank"))
        floor = lead.groupBy(*REST).agg(F.greatest(F.lit(float(least)), F.when(F.count("*") >= m, F.min("score"))).alias("floor"))
        packed = _packed(profiles.join(F.broadcast(floor), list(REST)), bases, asks)
        found = _dealt(queries, snapshots, bases, asks).groupBy("i", "j").cogroup(packed.groupBy("i", "j"))
        found = stored(found.applyInPandas(lambda rows, packed: _found(rows, packed, m), f"query_id {types['id']}, range_pct double, {features}, scenario {types['scenario']}, score double"))
        self = found.where("query_id IS NOT NULL").select("query_id", "scenario", F.lit(True).alias("own"), "score")
        most = self.groupBy("query_id").count().agg(F.max("count")).head()[0] or 0
        if most <= extra:
            break
        extra = most
    near = found.where("query_id IS NULL").select(*COLUMNS, "scenario", "score")
    near = near.unionByName(profiles.select(*COLUMNS).join(F.broadcast(lead), list(REST)).select(*COLUMNS, "scenario", "score"))
    near = near.groupBy(*COLUMNS, "scenario").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*COLUMNS).orderBy(F.desc(F.round("score", 9)), "scenario")
    near = near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= m)
    near = queries.select(F.col("id").alias("query_id"), *_values()).join(near, list(COLUMNS)).select("query_id", "scenario", F.lit(False).alias("own"), "score")
    one = near.unionByName(self).groupBy("query_id", "scenario").agg(F.max(F.struct("own", "score")).alias("_last"))
    return one.select("query_id", "scenario", F.round("_last.score", 14).alias("score")).where(F.col("score") >= max(least, 0.0))
