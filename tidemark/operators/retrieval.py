"""Search over texts and market snapshots: token overlap, similarity and nearest rows."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import Blocks, as_blocks


#: What a word, a shared tag, and a new document count, and the weight of each source.
TOKEN_WEIGHT, TAG_WEIGHT, RECENT_BONUS, RECENT_DAYS = 0.1, 0.05, 0.1, 365.0
SOURCE_WEIGHTS = {"evidence_graph": 1.0, "market_memory": 0.8, "knowledge_base": 0.9, "experiment_result": 0.7}
_WORDS = re.compile(r"[a-z_]+|[0-9]+")


def token_overlap(docs: DataFrame, queries: DataFrame, k: int, least: float = 0.0, most_queries: int = 100_000) -> DataFrame:
    """Top ``k`` documents per query: query_id, doc_id, hits, score, rank; ties to the smaller doc_id.

    The score is the share of the query's distinct words that a document holds times ten word weights, plus a bonus for
    each shared tag and for age, times the source's weight (0.5 for an unknown one), within [0, 1] and to four decimals.
    ``docs``: doc_id, text and, where there are any, source, tags (array), age_days; ``queries``: query_id, text and
    perhaps tags. Documents without words or without a shared word are no hits; null text has none.

    Queries are a stated set of at most ``most_queries``, which every task holds as an index from words to queries; each
    task keeps its ``k`` best of each query, so no pair of a common word ever becomes a row.
    """
    asked = queries.select("query_id", "text", (F.col("tags") if "tags" in queries.columns else F.array().cast("array<string>")).alias("tags")).limit(most_queries + 1).collect()
    if len(asked) > most_queries:
        raise ValueError(f"more than {most_queries} queries; search them in parts")
    words = [sorted(set(_WORDS.findall((r["text"] or "").lower()))) for r in asked]
    ids, sizes, tags = [r["query_id"] for r in asked], np.array([max(len(w), 1) for w in words]), [set(r["tags"] or []) for r in asked]
    index: dict[str, list[int]] = {}
    for q, own in enumerate(words):
        for w in own:
            index.setdefault(w, []).append(q)
    index = {w: np.array(q) for w, q in index.items()}
    has = set(docs.columns)
    source = reduce(lambda c, s: c.when(F.col("source") == s[0], s[1]), SOURCE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(0.5) if "source" in has else F.lit(1.0)
    age = F.when(F.col("age_days") >= 0, RECENT_BONUS * F.greatest(F.lit(0.0), 1 - F.col("age_days") / RECENT_DAYS)).otherwise(0.0) if "age_days" in has else F.lit(0.0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), source.alias("weight"), F.coalesce(age, F.lit(0.0)).alias("recent"), (F.col("tags") if "tags" in has else F.array().cast("array<string>")).alias("tags"))

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        found = pd.concat(parts).sort_values(["query", "score", "doc_id"], ascending=[True, False, True])
        return found.groupby("query", sort=False).head(k)

    def search(batches):
        kept, held = [], 0
        for batch in batches:
            for doc, text, weight, recent, own_tags in zip(batch["doc_id"], batch["text"], batch["weight"], batch["recent"], batch["tags"]):
                lists = [index[w] for w in set(_WORDS.findall(text.lower())) if w in index]
                if not lists:
                    continue
                hits = np.bincount(np.concatenate(lists), minlength=len(ids))
                q = np.flatnonzero(hits)
                extra = np.array([len(tags[i].intersection(own_tags)) for i in q]) * TAG_WEIGHT if len(own_tags) else 0.0
                score = np.floor(np.clip((hits[q] / sizes[q] * TOKEN_WEIGHT * 10 + extra + recent) * weight, 0, 1) * 1e4 + 0.5) / 1e4
                kept.append(pd.DataFrame({"query": q, "doc_id": doc, "hits": hits[q], "score": score})[score >= least])
                held += len(q)
                if held > 200_000:
                    kept = [best(kept)]
                    held = len(kept[0])
        if kept:
            found = best(kept)
            yield pd.DataFrame({"query_id": [ids[i] for i in found["query"]], "doc_id": found["doc_id"], "hits": found["hits"].astype("int64"), "score": found["score"]})

    found = rows.mapInPandas(search, f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, hits long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_rows(train: DataFrame, test: DataFrame, columns: list[str], by: str, k: int, block: int = 16384) -> DataFrame:
    """k nearest training rows (distance, then id) of each test row inside its group (fold): by, test_id, id, distance.

    ``by`` and ``id`` in both; a row is no neighbour of its own. Queries are few against the training rows: both are
    dealt into numbered blocks, a task holds one block of each and keeps k rows a query, so no pair is written out.
    """
    whole = train.select(by, "id", *columns).withColumn("_i", F.floor(F.col("id") / block).cast("long"))
    asked = test.select(by, "id", *columns).withColumn("_j", F.floor(F.col("id") / block).cast("long"))
    i, j = whole.select(by, "_i").distinct(), asked.select(by, "_j").distinct()
    both = whole.join(j, by).withColumn("_asks", F.lit(False)).unionByName(asked.join(i, by).withColumn("_asks", F.lit(True)))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        base, queries = rows[~rows["_asks"]].sort_values("id"), rows[rows["_asks"]]
        ids, x = base["id"].to_numpy(), base[columns].to_numpy(float)
        out = []
        for query, point in zip(queries["id"], queries[columns].to_numpy(float)):
            far = np.where(ids == query, np.inf, np.sqrt(((x - point) ** 2).sum(1)))
            near = np.argsort(far, kind="stable")[:k]
            near = near[np.isfinite(far[near])]
            out.append(pd.DataFrame({by: rows[by].iloc[0], "test_id": query, "id": ids[near], "distance": far[near]}))
        return pd.concat(out) if out else pd.DataFrame({by: [], "test_id": [], "id": [], "distance": []})

    kind = dict(train.dtypes)
    found = both.groupBy(by, "_i", "_j").applyInPandas(search, f"{by} {kind[by]}, test_id {kind['id']}, id {kind['id']}, distance double")
    w = Window.partitionBy(by, "test_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_snapshots(target: DataFrame, candidates: DataFrame, columns: list[str], n: int, least: float) -> DataFrame:
    """Most similar snapshots to one target row: 1 / (1 + distance), at least ``least``; ties by id."""
    point = target.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)]).limit(1)
    score = 1 / (1 + F.sqrt(sum((F.col(c) - F.col(f"_t{i}")) ** 2 for i, c in enumerate(columns))))
    return candidates.join(F.broadcast(point)).select("id", score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(n)


def sweep(bars: DataFrame | Blocks, grid: list[tuple[int, int]], least_trades: int, n: int, cost: float) -> DataFrame:
    """Best (fast, slow) crossover settings by mean profit per trade, at least so many trades; all settings share one
    scan, each as its own series key."""
    from tidemark.operators import labels as L
    from tidemark.operators import windows as W

    bars = as_blocks(bars, max(slow for _, slow in grid))
    parts = None
    for fast, slow in grid:
        e = W.crossovers(bars, fast, slow).select(F.concat_ws("|", "symbol", F.lit(f"{fast}/{slow}")).alias("symbol"), "ts", "price", F.when(F.col("direction") == "bullish", "BUY").otherwise("SELL").alias("action"))
        parts = e if parts is None else parts.unionByName(e)
    trades = L.first_of_runs(parts).withColumn("setting", F.element_at(F.split("symbol", "\\|"), -1))
    got = L.trade_summary(trades, cost, "setting").where(F.col("trades") >= least_trades)
    return got.orderBy(F.desc("mean"), "setting").limit(n)


def thin_breaks(breaks: DataFrame, gap: int, by: str = "symbol") -> DataFrame:
    """Breaks (by, idx, confidence): of those nearer than ``gap`` rows to the first of their cluster the surest stays.

    An ordered fold over the few candidate breaks of a series, not over its rows.
    """
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        best, anchor, out = None, None, []
        for row in rows.sort_values("idx").itertuples(index=False):
            if anchor is None or row.idx - anchor >= gap:
                if best is not None:
                    out.append(best)
                best, anchor = row, row.idx
            elif row.confidence > best.confidence:
                best = row
        return pd.DataFrame(out + ([best] if best is not None else []), columns=list(rows.columns))

    return breaks.groupBy(by).applyInPandas(fold, breaks.schema)
