"""Column functions: text, sentiment, time, policy, costs, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the sentiment lexicon.
POSITIVE = ("beat", "surge", "gain", "growth", "improve", "strong", "rise", "up", "positive", "exceeds", "record", "boost", "rally")
NEGATIVE = ("miss", "fall", "drop", "decline", "weak", "slow", "downgrade", "loss", "cut", "negative", "below", "fear", "plunge", "slump")


def clean_text(text: Column) -> Column:
    """Lower case, only letters, digits and spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of a text; an empty one has none."""
    return F.array_distinct(F.filter(F.split(clean_text(text), " "), lambda w: w != ""))


def news_text(text: Column) -> Column:
    """Lower case, only a-z, digits, spaces and %, $, ., -, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9\\s%$.-]", " "), "\\s+", " "))


def sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) over the distinct lexicon words of a text; 0 without any."""
    words = F.array_distinct(F.split(news_text(text), " "))
    p, n = F.size(F.array_intersect(words, F.array(*map(F.lit, positive)))), F.size(F.array_intersect(words, F.array(*map(F.lit, negative))))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / F.greatest(p + n, F.lit(1)))


def align(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def safe_divide(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b.isNull() | (b == 0), F.lit(empty)).otherwise(a / b)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def record_hash(*columns: str) -> Column:
    """SHA-256 of the row's JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def real_yield(nominal: Column, inflation: Column, fisher: bool = False) -> Column:
    return (1 + nominal) / (1 + inflation) - 1 if fisher else nominal - inflation


def policy_action(before: Column, now: Column) -> Column:
    """Word for a rate decision by the sign of the change; null before the first."""
    step = now - before
    return F.when(step.isNull(), None).when(step > 0, "hike").when(step < 0, "cut").otherwise("hold")


def parse_cost(spec: str | None, default: float = 0.0) -> tuple[str, float]:
    """Kind and value of a cost spec, ``fixed:X`` or ``pct:Y``; a bare number is fixed, an empty spec the default."""
    if not spec:
        return "fixed", default
    kind, colon, value = spec.partition(":")
    if not colon:
        return "fixed", float(spec)
    if kind.strip().lower() not in ("fixed", "pct"):
        raise ValueError(f"unknown cost {spec!r}")
    return kind.strip().lower(), float(value)


def cost(spec: str | None, price: Column, default: float = 0.0) -> Column:
    """Cost column of a spec, per unit of ``price``."""
    kind, value = parse_cost(spec, default)
    return F.lit(value) if kind == "fixed" else price * value


def regime(fast: Column, slow: Column, close: Column) -> Column:
    """Trend regime from two averages more than 1 % apart; unknown where one is missing or zero."""
    missing = F.coalesce((fast == 0) | (slow == 0) | (close == 0), F.lit(True))
    apart = F.abs(F.try_divide(fast - slow, slow)) > 0.01
    return F.when(missing, "Unknown").when(apart & (fast > slow), "Trending_Up").when(apart, "Trending_Down").otherwise("Ranging")


def volatility_state(fast: Column, slow: Column, atr: Column, close: Column) -> Column:
    """High over 2 %, Medium over 1 % of the close in average true range, else Low; Unknown as in :func:`regime`."""
    missing = F.coalesce((fast == 0) | (slow == 0) | (close == 0), F.lit(True))
    share = F.try_divide(atr, close) * 100
    return F.when(missing, "Unknown").when(share > 2, "High").when(share > 1, "Medium").otherwise("Low")


def field(array: str, name: str) -> Column:
    """The values of one field of an array of structs."""
    return F.transform(array, lambda x: x[name])


def sorted_unique(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))
