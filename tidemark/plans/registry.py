"""Registration of queries with SQL that says the same, and the inputs that queries share.

Doubles named in ``r`` are rounded and times named in ``t`` become text, on both sides, so that results compare."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.blocks import Blocks
from tidemark.sources import series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the inputs below, by name.
INPUTS = {
    "ticks": "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice / 997 AS price, 1.0::DOUBLE AS volume, o_orderkey AS seq FROM orders",
    "bars": "SELECT symbol, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, count(*) AS n_ticks FROM ticks GROUP BY symbol, ts",
    "hourly": "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value / 0.997, (ts, event_id)) AS open, max(value / 0.997) AS high, min(value / 0.997) AS low, arg_max(value / 0.997, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2",
    "factors": "SELECT event_type AS series_id, date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2",
    "rets": "SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars",
}
NEEDS = {"bars": ["ticks"], "rets": ["ticks", "bars"]}


def query(name: str, sql: str | None = None, use: str = "bars", r: str = "", t: str = "", digits: int = 6):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = f(spark, sf_dir)
            rounded = {c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in r.split()}
            texts = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c in t.split()}
            return df.withColumns(rounded | texts) if rounded or texts else df

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            names: list[str] = []
            for n in use.split():
                names += [x for x in [*NEEDS.get(n, []), n] if x not in names]
            heads = ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)
            body = sql.strip()
            if body.lower().startswith("with recursive "):
                inner = ("WITH RECURSIVE " + (heads + ", " if heads else "")) + body[15:]
            elif body.lower().startswith("with "):
                inner = "WITH " + (heads + ", " if heads else "") + body[5:]
            else:
                inner = (f"WITH {heads} " if heads else "") + body
            swaps = [f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in r.split()] + [f"strftime(\"{c}\"::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS \"{c}\"" for c in t.split()]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({inner}) AS q" if swaps else inner
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as timestamps in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 997).alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars, one series per order priority."""
    return B.from_ticks(ticks(spark, d), "day", F.col("seq"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars, one series per event type."""
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", (F.col("value") / 0.997).alias("price"), F.lit(1.0).alias("volume"), "event_id")
    return B.from_ticks(e, "hour", F.struct("ts", "event_id")).drop("n_ticks")


#: Inputs of :func:`stored` and the table that each is built from.
STORED = {"daily": (daily, "orders"), "hourly": (hourly, "events")}


def stored(spark: SparkSession, d: str, name: str) -> Blocks:
    """Daily or hourly bars as a stored table of series in blocks, as a job would keep them: built when it is first asked
    for in a session, and again when its source changes; measures read it without an exchange or a sort."""
    build, source = STORED[name]
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{source}.parquet")
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    version = hashlib.sha1(f"{place.toString()}:{status.getModificationTime()}:{status.getLen()}".encode()).hexdigest()[:16]
    table = f"tidemark_{name}_{version}"
    if not spark.catalog.tableExists(table):
        series.write(build(spark, d), table, size=1024, keep=True)
    return series.read(spark, table)


def factors(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("value"))


def with_returns(bars: DataFrame) -> DataFrame:
    from tidemark.operators.windows import previous

    before = previous("close")
    return bars.withColumn("r", F.when(before != 0, F.col("close") / before - 1))


# Short forms of SQL windows.
BY = "PARTITION BY symbol ORDER BY ts"


def over(w: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(value: str, of: str, w: int) -> str:
    return f"CASE WHEN count({of}) {over(w)} = {w} THEN {value} END"


def roll(f: str, of: str, w: int) -> str:
    return full(f"{f}({of}) {over(w)}", of, w)


def lag(of: str, n: int = 1) -> str:
    return f"lag({of}, {n}) OVER ({BY})"


#: Two-sided tails: the normal law by its series, and Student's by that of the incomplete beta function, which
#: converges fast on the side of the smaller argument.
NORMAL_P = "CASE WHEN abs({t}) >= 8 THEN 0 WHEN {t} = 0 THEN 1 ELSE greatest(0, 1 - 2 * exp(-{t} * {t} / 2) / sqrt(2 * pi()) * list_sum(list_transform(generate_series(0, 150), lambda k: exp((2 * k + 1) * ln(abs({t})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))) END"
_SERIES = "exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * (1 + list_sum(list_transform(generate_series(0, 400), lambda k: exp(lgamma({a} + 1) + lgamma({a} + {b} + k + 1) - lgamma({a} + {b}) - lgamma({a} + k + 2) + (k + 1) * ln({x})))))"
STUDENT_P = f"CASE WHEN {{t}} = 0 THEN 1 WHEN {{t}} * {{t}} > {{df}} THEN {_SERIES.format(a='({df} / 2.0)', b='0.5', x='({df} / ({df} + {t} * {t}))')} ELSE 1 - {_SERIES.format(a='0.5', b='({df} / 2.0)', x='({t} * {t} / ({df} + {t} * {t}))')} END"


def p_value(t: str, df: str) -> str:
    return f"CASE WHEN {df} >= 30 THEN {NORMAL_P.format(t=t)} WHEN {df} >= 1 THEN {STUDENT_P.format(t=t, df=df)} END"
