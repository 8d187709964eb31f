"""Price files: generic, terminal-export and chart-export CSV, ticks, quotes, trades and scalar macro series.

Columns are found by alias, whatever their case. Rows never leave the executors; only the header is looked at here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S

#: Accepted header names of each field.
ALIASES = {
    "ts": ("timestamp", "datetime", "date", "time", "open_time"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "v", "tick_volume", "tickvol"),
    "symbol": ("symbol", "ticker"),
}


def _plain(name: str) -> str:
    return name.strip().strip("<>").lower()


def by_alias(df: DataFrame, field: str, mapping: dict[str, str] | None = None) -> Column | None:
    """The first column that goes by one of the field's names, or by the given name."""
    names = {_plain(c): c for c in df.columns}
    for name in ((mapping or {}).get(field, ""), *ALIASES.get(field, (field,))):
        if _plain(name) in names:
            return F.col(f"`{names[_plain(name)]}`")
    return None


def utc(ts: Column, zone: str | Column = "UTC") -> Column:
    """Wall-clock times of a zone (IANA name or numeric offset, also by row) as UTC; an unknown zone is an error of the
    job."""
    return F.to_utc_timestamp(ts, zone)


def _read(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def parse_time(text: Column) -> Column:
    """Times as written by the usual exports, or epoch seconds and milliseconds by their size."""
    number = text.try_cast("double")
    return F.when(number >= 1e11, F.timestamp_millis(number.cast("long"))).when(number >= 1e9, F.timestamp_seconds(number)).otherwise(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy.MM.dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy.MM.dd HH:mm")), F.try_to_timestamp(text, F.lit("yyyy.MM.dd"))))


def _bars(df: DataFrame, ts: Column, symbol: str | None, timeframe: str, mapping=None) -> DataFrame:
    named = by_alias(df, "symbol", mapping)
    double = lambda f: (by_alias(df, f, mapping) if by_alias(df, f, mapping) is not None else F.lit(None)).cast("double").alias(f)
    missing = [f for f in ("open", "high", "low", "close") if by_alias(df, f, mapping) is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select((F.lit(symbol) if symbol or named is None else named).alias("symbol"), F.lit(timeframe).alias("timeframe"), ts.alias("ts"), *map(double, ("open", "high", "low", "close", "volume")))


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str = "1d", mapping: dict[str, str] | None = None, zone: str = "UTC") -> DataFrame:
    """Generic bars; ``symbol`` overrides the file's own column."""
    df = _read(spark, path)
    ts = by_alias(df, "ts", mapping)
    if ts is None:
        raise ValueError("no time column")
    return _bars(df, utc(parse_time(ts), zone), symbol, timeframe, mapping)


def load_terminal_bars(spark: SparkSession, path: str, symbol: str, timeframe: str, zone: str = "UTC", sep: str = "\t") -> DataFrame:
    """Exports with a Date and a Time column."""
    df = _read(spark, path, sep)
    names = {_plain(c): c for c in df.columns}
    return _bars(df, utc(parse_time(F.concat_ws(" ", F.col(f"`{names['date']}`"), F.col(f"`{names['time']}`"))), zone), symbol, timeframe)


def first_of_each(bars: DataFrame) -> DataFrame:
    """One row per (symbol, ts), the smallest in column order: file order does not exist in a distributed read."""
    w = Window.partitionBy("symbol", "ts").orderBy("open", "high", "low", "close", "volume")
    return bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def load_chart_bars(spark: SparkSession, path: str, symbol: str, timeframe: str, zone: str = "UTC", unique: bool = True) -> DataFrame:
    bars = load_bars(spark, path, symbol, timeframe, zone=zone)
    return first_of_each(bars) if unique else bars


def load_auto(spark: SparkSession, path: str, symbol: str, timeframe: str, zone: str = "UTC") -> DataFrame:
    """Picks the reader by the header alone."""
    head = spark.read.option("header", False).text(path).first()
    line = head[0].lower() if head else ""
    if "date" in line and "time" in line.replace("datetime", "").replace("timestamp", "") and ("\t" in line or "<" in line):
        return load_terminal_bars(spark, path, symbol, timeframe, zone)
    return load_chart_bars(spark, path, symbol, timeframe, zone)


def _fixed(spark: SparkSession, path: str, schema, symbol: str | None) -> DataFrame:
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumn("symbol", F.coalesce("symbol", F.lit(symbol))) if symbol else df


def load_ticks(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return _fixed(spark, path, S.TICKS, symbol)


def load_quotes(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return _fixed(spark, path, S.QUOTES, symbol)


def load_trades(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return _fixed(spark, path, S.TRADES, symbol)


def load_macro(spark: SparkSession, path: str, value: str) -> DataFrame:
    """day, value of a scalar series; a dot or blank is missing and dropped; a day given twice stops the job."""
    df = _read(spark, path)
    day, column = by_alias(df, "ts") if by_alias(df, "ts") is not None else F.col(f"`{df.columns[0]}`"), F.col(f"`{value}`")
    own = df.select(F.to_date(day).alias("day"), F.when(~F.trim(column).isin(".", ""), column).cast("double").alias("value")).where("value is not null")
    return gate(own, ["day"], [])


def gate(df: DataFrame, key: list[str], positive: list[str]) -> DataFrame:
    """``df`` unless a key is null or repeated or a price is null or not positive: one row of counts decides."""
    bad = sum((F.when(F.col(c).isNull() | (F.col(c) <= 0), 1).otherwise(0) for c in positive), F.lit(0)) + sum((F.col(k).isNull().cast("int") for k in key), F.lit(0))
    found = df.groupBy(*key).agg(F.count("*").alias("_n"), F.sum(bad).alias("_bad")).agg(F.sum((F.col("_n") > 1).cast("int")).alias("twice"), F.sum("_bad").alias("bad")).first()
    if found["twice"] or found["bad"]:
        raise ValueError(f"{found['twice']} keys occur twice, {found['bad']} values are missing or not positive")
    return df


def epoch_unit(df: DataFrame, column: str) -> str:
    """Seconds or milliseconds by the median size of a numeric time column; neither is an error."""
    middle = df.agg(F.percentile(F.abs(column), F.lit(0.5))).first()[0]
    if middle is None or middle < 1e9:
        raise ValueError("times are neither epoch seconds nor milliseconds")
    return "ms" if middle >= 1e11 else "s"


def from_epoch(df: DataFrame, column: str, out: str) -> DataFrame:
    """Epoch seconds or milliseconds, whichever the column's median size says, as times."""
    x = F.col(column)
    return df.withColumn(out, F.timestamp_millis(x.cast("long")) if epoch_unit(df, column) == "ms" else F.timestamp_seconds(x))
