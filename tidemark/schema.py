"""Table schemas and timeframes. Times are UTC; a missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _TS, _L = T.DoubleType(), T.StringType(), T.TimestampType(), T.LongType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LEVEL = _table(price=_D, size=_D, order_count=_L)
BARS = _table(symbol=_S, timeframe=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D, spread=_D, n_ticks=_L)
TICKS = _table(symbol=_S, ts=_TS, price=_D, volume=_D, side=_S, bid=_D, ask=_D)
QUOTES = _table(symbol=_S, ts=_TS, bid=_D, ask=_D, bid_size=_D, ask_size=_D)
TRADES = _table(symbol=_S, ts=_TS, price=_D, volume=_D, side=_S, trade_id=_S)
BOOKS = _table(symbol=_S, ts=_TS, bids=T.ArrayType(LEVEL), asks=T.ArrayType(LEVEL))
RELEASES = _table(series_id=_S, event_ts=_TS, release_ts=_TS, value=_D, forecast=_D, previous=_D, country=_S, severity=_S)
FACTORS = _table(day=T.DateType(), series_id=_S, value=_D)
AUDIT = _table(rowid=_L, entry_hash=_S, previous_entry=_S, ts=_TS, actor=_S, action=_S)

#: Seconds of each timeframe; a month counts 30 days.
TIMEFRAMES = {"tick": 0, "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800, "1mo": 2592000}
#: Other spellings.
ALIASES = {
    "1min": "1m", "minute": "1m", "5min": "5m", "15min": "15m", "30min": "30m",
    "1hour": "1h", "hour": "1h", "4hour": "4h",
    "1day": "1d", "daily": "1d", "day": "1d", "1week": "1w", "weekly": "1w", "week": "1w", "1month": "1mo", "monthly": "1mo", "month": "1mo",
}
#: Ours besides: names that terminals export.
ALIASES |= {"m1": "1m", "m5": "5m", "m15": "15m", "m30": "30m", "h1": "1h", "60m": "1h", "h4": "4h", "d1": "1d", "w1": "1w", "mn1": "1mo"}


def timeframe_seconds(name: str) -> int:
    """Seconds of a timeframe by its name or an alias; unknown names raise."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}")
    return TIMEFRAMES[key]
