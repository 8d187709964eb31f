"""Chat formatting of reply trees.

Messages form trees by ``parent``. Iterative self-joins double the distance of every message's ancestor pointer, so a
tree of depth d takes about log2(d) joins on unique message keys, over ever fewer messages; each level also sums the
scores it jumps over. Read from the highest to the lowest, the levels give the score of every leaf's branch, by which
branches are ranked, and then enumerate the messages of each chosen branch without holding an array per message.

Template: system, user and assistant turns become ``<<SYS>>…<</SYS>>``, ``[INST]…[/INST]`` and ``<s>…</s>`` blocks,
any other role ``[ROLE name]…[/ROLE]``. Inside a text a ``\\`` goes before every ``\\``
and every control string of the template, so that :func:`parse` reads the exact turns back.

Defined results: null text or role is empty; turns with equal position follow in the order of role, then text; an
empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": "\n<</SYS>>\n", "user": " [/INST]\n", "assistant": " </s>\n"}
OTHER = ("[ROLE ", "] ", " [/ROLE]\n")
#: Strings that the template itself writes, as they begin; a backslash goes before each of them inside a text.
CONTROL = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE", "[/ROLE]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_ROLE_HEAD = re.compile(r"\[ROLE ((?:\\.|[^\\\]])*)\] ", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escape_name(role: str) -> str:
    return re.sub(r"([\\\]\[<])", r"\\\1", role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the ranges, in code points, over which the loss is taken: assistant texts."""
    out, at, mask = [], 0, []
    for role, text in turns:
        if role in OPEN:
            head, tail = OPEN[role], CLOSE[role]
        else:
            head, tail = OTHER[0] + _escape_name(role) + OTHER[1], OTHER[2]
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from :func:`render`'s text."""
    turns, at = [], 0
    while at < len(formatted):
        head = next((r for r, s in OPEN.items() if formatted.startswith(s, at)), None)
        if head:
            start, tail = at + len(OPEN[head]), CLOSE[head]
            role = head
        else:
            m = _ROLE_HEAD.match(formatted, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            role, start, tail = unescape(m[1]), m.end(), OTHER[2]
        stop = _closing(formatted, start, tail)
        turns.append((role, unescape(formatted[start:stop])))
        at = stop + len(tail)
    return turns


def _closing(formatted: str, start: int, tail: str) -> int:
    """Where ``tail`` stands unescaped: its control string has no odd run of backslashes before it."""
    mark = tail.strip()
    shift = tail.index(mark)
    at = formatted.find(tail, start)
    while at >= 0:
        before = at + shift
        run = 0
        while before - 1 - run >= start and formatted[before - 1 - run] == "\\":
            run += 1
        if run % 2 == 0:
            return at
        at = formatted.find(tail, at + 1)
    raise ValueError("a turn has no end")


def reply_edges(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees of one branch: node, parent (previous turn), tree, role, text, score.

    ``seat`` numbers the turns of a conversation from 0 by (turn, role, text).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seats = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("seat", F.row_number().over(order) - 1)
    key = lambda seat: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), seat.cast("string"))
    return seats.select(
        F.col("conv_id").alias("tree"),
        key(F.col("seat")).alias("node"),
        F.when(F.col("seat") > 0, key(F.col("seat") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


def best_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: tree, branch, leaf, node, depth (from the leaf, 0 up).

    ``messages``: tree, node (unique), parent (null at a root), score (null counts 0). A parent that is no node, or a
    cycle, ends the path: pointers to absent nodes count as roots, and members of a cycle have no root and no branch.
    """
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select(F.col("node").alias("parent"))
    jump = stored(links.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), "score"))
    jumps, nodes = [], None
    while not jump.isEmpty():
        nodes = links.count() if nodes is None else nodes
        if 1 << len(jumps) > nodes:  # further back than there are messages: these run in circles
            break
        jumps.append(jump)
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"))
        jump = stored(jump.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score")))
    parents = links.select(F.col("parent").alias("node")).where(F.col("node").isNotNull())
    leaves = links.join(parents, "node", "left_anti").join(jump.select("node"), "node", "left_anti")
    climb = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("steps"))
    for k in range(len(jumps) - 1, -1, -1):
        climb = climb.join(jumps[k], "node", "left").select(
            "tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"), (F.col("steps") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("steps")
        )
        climb = stored(climb) if k % 3 == 2 else climb
    scored = climb.join(links.select("node", "score"), "node").select("tree", "leaf", "steps", (F.col("total") + F.col("score")).alias("score"))
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("steps"), "leaf")
    chosen = scored.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = stored(chosen.select("tree", "branch", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth")))
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select("node", "up")
        path = path.unionByName(path.join(up, "node").select("tree", "branch", "leaf", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth")))
        path = stored(path) if k % 3 == 0 else path
    return path


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            text, mask = render([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            masks.append([{"start": s, "end": e} for s, e in mask])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("branch"), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["tree", "branch", "formatted", "loss_mask"],
        )


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen branch: tree, branch, formatted, loss_mask (array of start, end in code points)."""
    path = best_branches(messages, branches)
    turns = (
        path.join(messages.select("node", "role", "text"), "node")
        .groupBy("tree", "branch")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"))
    )
    tree_type = dict(messages.dtypes)["tree"]
    return turns.mapInArrow(_format, f"tree {tree_type}, branch int, formatted string, loss_mask array<struct<start: long, end: long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist()):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[m["start"] : m["end"]]) for m in mask)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *map(pa.array, columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted text."""
    formatted = format_trees(stored(reply_edges(conversations)))
    id_type = dict(conversations.dtypes)["conv_id"]
    return formatted.mapInArrow(_digest, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
