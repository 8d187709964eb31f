"""Stream jobs over bars and events. The same functions work on batch frames where state allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream, ``files`` per batch; a pattern lets the path be a single file."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; complete mode keeps the last state."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{scratch(spark)}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def windows(events: DataFrame, duration: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and mean by tumbling or sliding window."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return own.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean")


def live_bars(ticks: DataFrame, duration: str, late: str = "1 day") -> DataFrame:
    """Bars from a tick stream with a bound on late rows."""
    own = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    at = F.struct("ts", "seq")
    return own.groupBy("symbol", F.window("ts", duration).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def unique(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def activity(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a user separated by gaps."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def against_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live rows (symbol, day, close, volume) against a static table: close difference and volume ratio."""
    past = history.select("symbol", "day", F.col("close").alias("past_close"), F.col("volume").alias("past_volume"))
    return live.join(past, ["symbol", "day"]).select("symbol", "day", ((F.col("close") - F.col("past_close")) / F.col("past_close")).alias("close_diff"), (F.col("volume") / F.col("past_volume")).alias("volume_ratio"))


#: Rows that a fold over a stream takes, and hands on, at once.
SLICE = 65_536


def _in_order(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[np.ndarray, list[float]]]:
    """A symbol's rows of one batch by (ts, seq), as slices of times and values. Only three numbers a row are held."""
    ts, seq, values = bytearray(), bytearray(), bytearray()
    for batch in batches:
        ts += batch["ts"].to_numpy("datetime64[ns]").tobytes()
        seq += batch["seq"].fillna(2**62).to_numpy("int64").tobytes()  # rows without a number come last
        values += batch[column].to_numpy(float).tobytes()
    ts, seq, values = np.frombuffer(ts, "datetime64[ns]"), np.frombuffer(seq, "int64"), np.frombuffer(values, float)
    order = np.lexsort((seq, ts))
    del seq
    for lo in range(0, len(order), SLICE):
        at = order[lo : lo + SLICE]
        yield ts[at], values[at].tolist()


_MONITOR = "symbol string, n long, total double, peak double, drawdown double, streak int, alarms int"


def monitor(rows: DataFrame, threshold: float, drift: float = 0.0) -> DataFrame:
    """Running CUSUM alarms, drawdown and streak per symbol of a value stream (symbol, ts, seq, value).

    Rows of one batch are taken in order of (ts, seq), for which a task holds three numbers for each of a symbol's; the
    state per symbol is seven numbers.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, peak, worst, streak, up, alarms = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, 0.0, 0)
        for value in chain.from_iterable(values for _, values in _in_order(batches, "value")):
            n, total = n + 1, total + value
            peak = max(peak, total)
            worst = min(worst, total - peak)
            streak = (streak + 1 if streak > 0 else 1) if value > 0 else (streak - 1 if streak < 0 else -1) if value < 0 else 0
            up = max(0.0, up + value - drift)
            if up > threshold:
                up, alarms = 0.0, alarms + 1
        state.update((n, total, peak, worst, streak, up, alarms))
        yield pd.DataFrame([(key[0], n, total, peak, worst, streak, alarms)], columns=["symbol", "n", "total", "peak", "drawdown", "streak", "alarms"])

    kept = "n long, total double, peak double, worst double, streak int, up double, alarms int"
    return rows.groupBy("symbol").applyInPandasWithState(update, _MONITOR, kept, "update", "NoTimeout")


def fan_out(stream: DataFrame, topics: dict[str, Callable[[DataFrame], None]], topic: str = "event_type"):
    """Each batch's rows of a topic to that topic's subscriber; returns the running query."""

    def publish(batch: DataFrame, _: int) -> None:
        kept = batch.where(F.col(topic).isin(*topics)).persist()
        for name, subscriber in topics.items():
            subscriber(kept.where(F.col(topic) == name))
        kept.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", scratch(stream.sparkSession)).trigger(availableNow=True).start()


def count_windows(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` rows that start every ``step`` rows of a symbol's stream (symbol, ts, seq, value): symbol,
    start (row number), first and last time, mean. The state holds the rows that a later window still needs."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, start, times, values = state.get if state.exists else (0, 0, [], [])
        times, values = list(times), list(values)
        for stamps, new in _in_order(batches, "value"):
            out = []
            for t, v in zip(stamps.astype("datetime64[us]").astype("int64").tolist(), new):
                at += 1
                if at <= start:  # between two windows, where the step is longer than they are
                    continue
                times.append(t)
                values.append(v)
                if at - start >= size:
                    out.append((key[0], start, pd.Timestamp(times[0] * 1000), pd.Timestamp(times[size - 1] * 1000), sum(values[:size]) / size))
                    start += step
                    times, values = times[step:], values[step:]
            yield pd.DataFrame(out, columns=["symbol", "start", "first_ts", "last_ts", "mean"]).astype({"start": "int64"})
        state.update((at, start, times, values))

    return rows.groupBy("symbol").applyInPandasWithState(update, "symbol string, start long, first_ts timestamp, last_ts timestamp, mean double", "at long, start long, times array<long>, vals array<double>", "append", "NoTimeout")


def live_crossovers(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """Indicators and crossing signals of a bar stream (symbol, ts, seq, close): both averages once they are full, MACD
    and its signal line, and 1 or -1 where the fast average crosses the slow one; averages equal to nine decimals are
    equal. The state is the last ``slow`` closes and four numbers per symbol."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, closes, quick, late, line, before = state.get if state.exists else (0, [], 0.0, 0.0, 0.0, 0.0)
        closes = list(closes)
        for stamps, new in _in_order(batches, "close"):
            out = []
            for c in new:
                closes = [*closes, c][-slow:]
                quick, late = (c, c) if n == 0 else (quick + (c - quick) * 2 / 13, late + (c - late) * 2 / 27)
                macd = quick - late
                line = macd if n == 0 else line + (macd - line) * 2 / 10
                n += 1
                a, b = (sum(closes[-fast:]) / fast if n >= fast else None), (sum(closes) / slow if n >= slow else None)
                gap = round(a - b, 9) if b is not None else 0.0
                crossed = 0 if b is None or n == slow else 1 if before <= 0 < gap else -1 if before >= 0 > gap else 0
                before = gap
                out.append((key[0], c, a, b, macd, line, crossed))
            rows = pd.DataFrame(out, columns=["symbol", "close", "fast", "slow", "macd", "line", "signal"]).astype({"fast": float, "slow": float, "signal": "int32"})
            rows.insert(1, "ts", stamps)
            yield rows
        state.update((n, closes, quick, late, line, before))

    kept = "n long, closes array<double>, quick double, late double, line double, before double"
    return bars.groupBy("symbol").applyInPandasWithState(update, "symbol string, ts timestamp, close double, fast double, slow double, macd double, line double, signal int", kept, "append", "NoTimeout")
