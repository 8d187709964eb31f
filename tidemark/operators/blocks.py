"""Measures over ordered series of any length, in blocks of rows.

A measure says how many rows back and ahead of a row it reads (:func:`reads`). :func:`cut` numbers the rows of each
series, cuts them into blocks and copies to each block the neighbouring rows that measures reach, so that a block is a
series of its own: its key, in column ``symbol``, is the series and the block's number. Windows over ``symbol`` are then
windows over blocks, and a series of any length spreads over many tasks. Rows that a measure computes for copies are
dropped. Several measures can be stacked on one cut, and one sort serves them all.

What depends on all rows before (running totals, recurrences, state machines) is worked out inside blocks and carried
over a small table with one row a block.

Frames of blocks carry columns whose names begin with two underscores; measures pass them on (:func:`base`).
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import row_index

SIZE = 1 << 16
MARK, NOBODY = "\u001f", "\u0000"


def base(df: DataFrame) -> list[str]:
    """The columns that every measure passes on."""
    return ["symbol", "ts", *[c for c in df.columns if c.startswith("__")]]


def reads(back=0, ahead=0):
    """Marks a measure f(rows, ...) with the rows that it reads before and after each row: numbers, or functions of the
    measure's arguments by name. It then takes blocks, which must hold as many neighbours, or plain rows, which it cuts."""

    def mark(f):
        signature = inspect.signature(f)

        def reach(*args, **kw) -> tuple[int, int]:
            bound = signature.bind(*args, **kw)
            bound.apply_defaults()
            return tuple(int(x(bound.arguments)) if callable(x) else x for x in (back, ahead))

        @functools.wraps(f)
        def run(rows, *args, **kw):
            if isinstance(rows, DataFrame) and "__idx" in rows.columns:
                return f(rows, *args, **kw)
            b, a = reach(rows, *args, **kw)
            return as_blocks(rows, b, a).measure(lambda df: f(df, *args, **kw), b, a)

        run.reach, run.inside = reach, f
        return run

    return mark


def block_number() -> Column:
    return F.substring_index("symbol", MARK, -1).cast("long")


@dataclass(frozen=True)
class Blocks:
    """Rows with their neighbours. ``frame``: symbol (series and block), ts, __idx (row number in the series), __block,
    __name (the series as text) and values; ``back``, ``ahead``: copied rows around each block; ``most``: blocks of the longest series where that is known."""

    frame: DataFrame
    size: int
    back: int
    ahead: int
    symbol_type: str = "string"
    most: int | None = None

    def inside(self) -> Column:
        """True for rows that belong to their block."""
        return F.col("__idx").between(F.col("__block") * self.size, F.col("__block") * self.size + (self.size - 1))

    def named(self, df: DataFrame) -> DataFrame:
        """``symbol`` as it was given."""
        name = F.col("__name")
        return df.withColumn("symbol", F.when(name != NOBODY, name).cast(self.symbol_type))

    def own(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` that belong to their block, as rows of the series."""
        got = self.named(df.where(self.inside()))
        return got.drop(*[c for c in got.columns if c.startswith("__")])

    def rows(self) -> DataFrame:
        return self.own(self.frame)

    def _check(self, back: int, ahead: int) -> None:
        if back > self.back or ahead > self.ahead:
            raise ValueError(f"blocks hold {self.back} rows before and {self.ahead} after; {back} and {ahead} are read")

    def measure(self, f: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0) -> DataFrame:
        self._check(back, ahead)
        return self.own(f(self.frame))

    def extend(self, f: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0) -> Blocks:
        """Blocks of what ``f`` returns; what it read is no longer there for later measures to read."""
        self._check(back, ahead)
        return replace(self, frame=f(self.frame), back=self.back - back, ahead=self.ahead - ahead)

    def stack(self, *measures: Callable) -> DataFrame:
        """The columns of several marked measures (with their arguments bound by ``functools.partial``), one sort."""
        values = [c for c in self.frame.columns if c not in base(self.frame)]
        df = self.frame.select(*base(self.frame), F.struct(*values).alias("__in"))
        for k, f in enumerate(measures):
            part = f if isinstance(f, functools.partial) else functools.partial(f)
            self._check(*part.func.reach(self.frame, *part.args, **part.keywords))
            got = part.func.inside(df.select("*", "__in.*"), *part.args, **part.keywords)
            kept = base(got)
            df = got.select(*kept, F.struct(*[c for c in got.columns if c not in kept]).alias(f"__out{k}"))
        outs = [f"__out{k}.*" for k in range(len(measures))]
        return self.named(df.where(self.inside())).select("symbol", "ts", *outs)

    def running(self, sums: dict[str, str | Column], f: Callable = F.sum) -> Blocks:
        """Running totals (``f``: F.sum, F.max or F.min) over the series up to each row; on copies they are null."""
        df = self.frame.withColumns({f"_of_{n}": F.when(self.inside(), F.col(c) if isinstance(c, str) else c) for n, c in sums.items()})
        so_far = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        if self.most == 1:
            return replace(self, frame=df.withColumns({n: f(f"_of_{n}").over(so_far) for n in sums}).drop(*[f"_of_{n}" for n in sums]))
        zero = lambda c: F.coalesce(c, F.lit(0))
        joined = {F.max: F.greatest, F.min: F.least}.get(f, lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), zero(F.col(a)) + zero(F.col(b))))
        total = df.groupBy("symbol").agg(*[f(f"_of_{n}").alias(f"_all_{n}") for n in sums])
        before = Window.partitionBy("_series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        total = total.withColumns({"_series": F.substring_index("symbol", MARK, 1), "_block": block_number()})
        carried = total.select("symbol", *[f(f"_all_{n}").over(before).alias(f"_before_{n}") for n in sums])
        inside = df.withColumns({n: f(f"_of_{n}").over(so_far) for n in sums}).join(carried, "symbol")
        got = inside.withColumns({n: F.when(self.inside(), joined(n, f"_before_{n}")) for n in sums})
        return replace(self, frame=got.drop(*[f"_{k}_{n}" for n in sums for k in ("of", "before")]))

    def expanding(self, of: str) -> Blocks:
        """``n``, ``mean`` and ``m2`` (sum of squared deviations) of all values up to each row: moments inside the block
        merged with those of the blocks before."""
        x = F.when(self.inside(), F.col(of))
        so_far = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        moments = lambda over: F.struct(over(F.count(x)).alias("n"), over(F.avg(x)).alias("mean"), (over(F.var_pop(x)) * over(F.count(x))).alias("m2"))
        inside = self.frame.withColumn("_in", moments(lambda f: f.over(so_far)))
        if self.most == 1:
            return replace(self, frame=inside.select(*self.frame.columns, "_in.*"))
        total = self.frame.groupBy("symbol").agg(moments(lambda f: f).alias("_all"))
        earlier = Window.partitionBy(F.substring_index("symbol", MARK, 1)).orderBy(block_number()).rowsBetween(Window.unboundedPreceding, -1)
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
        carried = total.select("symbol", F.aggregate(F.collect_list("_all").over(earlier), none, _merged).alias("_before"))
        got = inside.join(carried, "symbol").withColumn("_in", _merged(F.col("_before"), F.col("_in")))
        return replace(self, frame=got.select(*self.frame.columns, "_in.*"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two sets of values as moments of both."""
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + delta * b["n"] / n)
    m2 = F.when(a["n"] == 0, b["m2"]).when(b["n"] == 0, a["m2"]).otherwise(a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n)
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def cut(rows: DataFrame, back: int, ahead: int = 0, size: int = SIZE, keep: bool = False) -> Blocks:
    """Blocks of ``size`` rows of each series with ``back`` rows before and ``ahead`` after. A missing symbol is a series.

    Numbering reads the rows twice; ``keep`` writes them down first, so that what they come from is worked out once.
    """
    if keep:
        from tidemark.sources.scratch import stored

        rows = stored(rows)
    kind = dict(rows.dtypes)["symbol"]
    named = rows.withColumn("symbol", F.coalesce(F.col("symbol").cast("string"), F.lit(NOBODY)))
    own = row_index(named, name="__idx")
    # the blocks whose frames reach the row
    first, last = F.greatest(F.floor((F.col("__idx") - ahead) / size), F.lit(0)), F.floor((F.col("__idx") + back) / size)
    held = own.withColumn("__block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    key = F.concat_ws(MARK, F.col("symbol"), F.col("__block").cast("string"))
    return Blocks(held.withColumn("__name", F.col("symbol")).withColumn("symbol", key), size, back, ahead, kind)


def as_blocks(rows: DataFrame | Blocks, back: int, ahead: int = 0) -> Blocks:
    return rows if isinstance(rows, Blocks) else cut(rows, back, ahead, keep=True)


State = np.ndarray
Fold = Callable[[pd.DataFrame, State | None], tuple[dict[str, np.ndarray], State]]


def _ordered(rows: pd.DataFrame, size: int) -> tuple[pd.DataFrame, str, int]:
    """Own rows of a block in order, the block's key and number."""
    key = rows["symbol"].iloc[0]
    block = int(key.rsplit(MARK, 1)[1])
    return rows[rows["__idx"] // size == block].sort_values("__idx"), key, block


def pa_doubles(x: np.ndarray) -> pd.arrays.ArrowExtensionArray:
    """Doubles in which NaN is a missing value."""
    return pd.array(pa.array(x, pa.float64(), from_pandas=True), dtype=pd.ArrowDtype(pa.float64()))


def _outputs(blocks: Blocks, fold: Fold, starts: DataFrame | None, outs: list[str]) -> Blocks:
    """Rows of each block folded from the state that it starts with."""
    size = blocks.size
    shape = ", ".join([*(f"`{c}` {t}" for c, t in blocks.frame.dtypes), *(f"`{o}` double" for o in outs)])

    def run(rows: pd.DataFrame, start: State | None) -> pd.DataFrame:
        own, _, _ = _ordered(rows, size)
        got = fold(own, start)[0] if len(own) else {}
        # copies of neighbours stay, without outputs
        return rows.assign(**{o: pd.Series(pa_doubles(got.get(o, np.zeros(0))), index=own.index).reindex(rows.index) for o in outs})

    if starts is None:
        got = blocks.frame.groupBy("symbol").applyInPandas(lambda rows: run(rows, None), shape)
    else:
        pair = lambda rows, s: run(rows, None if not len(s) or s["start"].iloc[0] is None else np.array(s["start"].iloc[0], float)) if len(rows) else pd.DataFrame(columns=[*rows.columns, *outs])
        got = blocks.frame.groupBy("symbol").cogroup(starts.groupBy("symbol")).applyInPandas(pair, shape)
    return replace(blocks, frame=got)


def linear_fold(blocks: Blocks, fold: Fold, dim: int, outs: list[str]) -> Blocks:
    """``fold`` over each series in order, where outputs and end state are affine in the start state of ``dim`` numbers.

    Every block but the first is run from the zero state and from each unit state: the ends make a matrix. Matrices are
    applied one after the other over the few blocks of a series, and each block is run once more from its true start. A
    fold gets None at the start of a series. On copied rows the outputs are null.
    """
    if blocks.most == 1:
        return _outputs(blocks, fold, None, outs)
    size = blocks.size

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        own, key, block = _ordered(rows, size)
        if not len(own):
            return pd.DataFrame(columns=["symbol", "series", "block", "ends"])
        trials = [None] if block == 0 else [np.zeros(dim), *np.eye(dim)]
        found = [fold(own, s)[1] for s in trials]
        return pd.DataFrame({"symbol": [key], "series": [key.rsplit(MARK, 1)[0]], "block": [block], "ends": [np.concatenate(found).tolist()]})

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("block"), None, []
        for key, block, found in zip(rows["symbol"], rows["block"], rows["ends"]):
            out.append((key, None if block == 0 else state.tolist()))
            e = np.array(found, float).reshape(-1, dim)
            state = e[0] if block == 0 else e[0] + (e[1:] - e[0]).T @ state
        return pd.DataFrame(out, columns=["symbol", "start"])

    table = blocks.frame.groupBy("symbol").applyInPandas(ends, "symbol string, series string, block long, ends array<double>")
    return _outputs(blocks, fold, table.groupBy("series").applyInPandas(starts, "symbol string, start array<double>"), outs)


def coalescing_fold(blocks: Blocks, fold: Fold, guess: Callable[[pd.DataFrame], State], outs: list[str]) -> Blocks:
    """``fold`` over each series in order, for state machines whose paths from different starts soon meet.

    Every block is run from a guessed state; its end is taken as the start of the block after it; blocks are run again
    where their start has changed, until no end changes. Ends are true from the first block on, so this stops after as
    many rounds as there are blocks at most, and after one where paths meet inside a block. Only the table of ends, one
    row a block, is kept between rounds. Then outputs are made, once; on copied rows they are null.
    """
    if blocks.most == 1:
        return _outputs(blocks, fold, None, outs)
    from tidemark.sources.scratch import stored

    size = blocks.size
    shape = "symbol string, series string, block long, start array<double>, end array<double>"

    def run(rows: pd.DataFrame, start: State | None, guessed: bool) -> pd.DataFrame:
        own, key, block = _ordered(rows, size)
        if not len(own):
            return pd.DataFrame(columns=["symbol", "series", "block", "start", "end"])
        s = None if block == 0 else guess(own) if guessed else start
        return pd.DataFrame({"symbol": [key], "series": [key.rsplit(MARK, 1)[0]], "block": [block], "start": [None if s is None else s.tolist()], "end": [fold(own, s)[1].tolist()]})

    table = stored(blocks.frame.groupBy("symbol").applyInPandas(lambda rows: run(rows, None, True), shape))
    while True:
        before = Window.partitionBy("series").orderBy("block")
        linked = table.withColumn("next", F.lag("end").over(before))
        stale = linked.where((F.col("block") > 0) & ~F.col("start").eqNullSafe(F.col("next"))).select("symbol", F.col("next").alias("start"))
        if stale.isEmpty():
            return _outputs(blocks, fold, table.select("symbol", "start"), outs)
        again = lambda rows, s: run(rows, np.array(s["start"].iloc[0], float), False) if len(rows) and len(s) else pd.DataFrame(columns=["symbol", "series", "block", "start", "end"])
        redone = blocks.frame.join(stale.select("symbol"), "symbol", "left_semi").groupBy("symbol").cogroup(stale.groupBy("symbol")).applyInPandas(again, shape)
        table = stored(table.join(stale.select("symbol"), "symbol", "left_anti").unionByName(redone))
