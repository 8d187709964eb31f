"""Lineage graphs held as edges (parent, child): closure, paths, order, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored


#: Rounds of one edge each before rounds double their length; a power of two.
SINGLE = 8
#: Pairs of nodes, in multiples of the number of edges, up to which rounds double.
PAIRS = 8


def closure(edges: DataFrame, starts: DataFrame, up: bool = False, until: str | None = None) -> DataFrame:
    """Descendants (``up``: ancestors) of every start node at any depth: start, node, depth (the least). Cycles end, as a
    node is reached once; a start is not its own descendant. ``until``: stop when this node has been reached.

    All starts move on together. First rounds follow one edge from the nodes that are new. Deeper graphs go on by
    doubling: what is within m edges, joined with the pairs that are exactly m edges apart, gives what is within 2 m, so
    a chain takes as many rounds as its depth has binary digits. Where hubs would make many more such pairs than there are
    edges, rounds go on one edge at a time. What a round finds is stored once and not written again.
    """
    here, there = ("child", "parent") if up else ("parent", "child")
    links = stored(edges.select(F.col(here).alias("node"), F.col(there).alias("to")).where("node is not null and to is not null").distinct())
    found = [stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).where("node is not null").distinct())]
    hops, length, depth, most = links, 1, 0, 0
    while True:
        known = reduce(DataFrame.unionByName, found)
        if depth >= SINGLE and most == 0:
            most = PAIRS * links.count()
        while hops is not None and depth >= SINGLE and length < depth:
            hops, length = (_twice(hops), 2 * length) if _pairs(hops) <= most else (None, 1)
        if depth < SINGLE or hops is None:
            reached, by, step = known.where(F.col("depth") == depth), links, 1
        else:
            reached, by, step = known, hops, length
        new = reached.join(by, "node").groupBy("start", F.col("to").alias("node")).agg((F.min("depth") + step).alias("depth"))
        fresh = stored(new.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        depth += step
        if fresh.isEmpty():
            break
        found.append(fresh)
        if until is not None and not fresh.where(F.col("node") == until).isEmpty():
            break
    return reduce(DataFrame.unionByName, found).where("depth > 0")


def _pairs(hops: DataFrame) -> int:
    """Rows that joining the pairs with themselves makes."""
    into, out = hops.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("a")), hops.groupBy("node").agg(F.count("*").alias("b"))
    return into.join(out, "node").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def _twice(hops: DataFrame) -> DataFrame:
    """Pairs twice as many edges apart."""
    return stored(hops.join(hops.select(F.col("node").alias("to"), F.col("to").alias("_end")), "to").select("node", F.col("_end").alias("to")).distinct())


def shortest_path(edges: DataFrame, start: str, end: str) -> list[str]:
    """One shortest undirected path; among equals the smallest predecessors win. Empty where there is none.

    Depths from the start come from :func:`closure`. Every node's predecessor, the smallest neighbour one edge nearer,
    makes a forest, in which the ancestors of the end are the path; only that reaches the driver.
    """
    both = edges.select("parent", "child").unionByName(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    session = edges.sparkSession
    if start == end:
        return [start]
    source = session.createDataFrame([(start,)], "node string")
    depths = stored(closure(both, source, until=end).select("node", "depth").unionByName(source.withColumn("depth", F.lit(0).cast("long"))))
    if depths.where(F.col("node") == end).isEmpty():
        return []
    near, far = depths.select(F.col("node").alias("parent"), F.col("depth").alias("_d")), depths.select(F.col("node").alias("child"), "depth")
    forest = both.join(near, "parent").join(far, "child").where(F.col("depth") == F.col("_d") + 1).groupBy("child").agg(F.min("parent").alias("parent"))
    back = closure(forest, session.createDataFrame([(end,)], "node string"), up=True)
    return [*[r["node"] for r in back.orderBy(F.desc("depth")).collect()], end]


def content_hash(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Hash of a node's type and payload in a form that does not depend on the order of columns: node, content."""
    return nodes.select("node", F.sha2(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}), 256).alias("content"))


def lineage_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hash of a node's own hash and the sorted hashes of its parents."""
    parents = edges.groupBy("child").agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("_parents"))
    return nodes.join(parents.withColumnRenamed("child", "node"), "node", "left").select("node", F.sha2(F.concat_ws("|", "node", F.coalesce("_parents", F.lit(""))), 256).alias("lineage"))


def append_only(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``incoming`` (id, hash) to insert, and those that change the content of a known id."""
    fresh = incoming.join(known.select("id"), "id", "left_anti")
    changed = incoming.join(known.select("id", F.col("hash").alias("known_hash")), "id").where(F.col("hash") != F.col("known_hash"))
    return fresh, changed


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    into = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("parents"))
    return out.join(into, "node", "full_outer").fillna(0, ["children", "parents"])


def parents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("child") == node).select(F.col("parent").alias("node")).distinct()


def children(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("parent") == node).select(F.col("child").alias("node")).distinct()


def canonical_order(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes (type, hash) by the rank of their type, then by hash: rank, place within the rank. Unknown types come last.
    Places are counted within two hash digits and summed up, so no task holds all nodes of a type."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)])[F.col("type")], F.lit(len(types)))
    own = nodes.select("*", rank.alias("rank"), F.substring("hash", 1, 2).alias("_p"))
    sizes = own.groupBy("rank", "_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("rank").orderBy("_p")) - F.col("_n")).drop("_n")
    inside = own.withColumn("_k", F.row_number().over(Window.partitionBy("rank", "_p").orderBy("hash")))
    return inside.join(F.broadcast(before), ["rank", "_p"]).withColumn("place", (F.col("_before") + F.col("_k")).cast("int")).drop("_p", "_before", "_k")


def typed_chains(edges: DataFrame, parent_type, child_type, types: list[str]) -> DataFrame:
    """Chains of edges that go from the first type to the last one step at a time: one column for each type."""
    own = edges.select("parent", "child", parent_type.alias("_p"), child_type.alias("_c"))
    chain = None
    for above, below in zip(types, types[1:]):
        link = own.where((F.col("_p") == above) & (F.col("_c") == below)).select(F.col("parent").alias(above), F.col("child").alias(below)).distinct()
        chain = link if chain is None else chain.join(link, above)
    return chain
