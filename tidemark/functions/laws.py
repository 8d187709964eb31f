"""Distribution functions as column expressions: no array as long as a count, no Python in the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, less the factors in between."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    between = F.log(x)
    for k in range(1, 8):
        between = between + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - between


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's rule; converges for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(s: Column, term: Column) -> Column:
        d, c = 1 / away(1 + term * s["d"]), away(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(turn(s, even), odd)

    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column, most: int = 100_000) -> Column:
    """Regularised incomplete beta function I_x(a, b), by a continued fraction whose length grows with the square root
    of the larger parameter; to twelve digits up to parameters of 10^8, where ``most`` steps bind."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    steps = F.least(F.ceil(6 * F.sqrt(F.greatest(a, b))) + 60, F.lit(most)).cast("int")
    # F.log gives null for 0, which the outer cases answer
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x, steps) / a
    high = 1 - front * _fraction(b, a, 1 - x, steps) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))


def normal_tail(t: Column, terms: int = 120) -> Column:
    """Two-sided tail of the standard normal law by the series of its distribution function; 0 beyond 8 deviations."""
    x = F.least(F.abs(t), F.lit(8.0))
    start = F.struct(x.alias("term"), x.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * x * x / (2 * k + 1)).alias("total")))["total"]
    return F.when(F.abs(t) >= 8, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * total * F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's law; from 30 degrees of freedom on the normal one. Null without a degree of freedom."""
    small = incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))
    return F.when(df >= 30, normal_tail(t)).when(df >= 1, small)


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X >= k) of n fair throws: I_1/2(k, n - k + 1)."""
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(incomplete_beta(k, n - k + 1, F.lit(0.5)))


#: Critical values by level.
CRITICAL = {0.90: 1.645, 0.95: 1.960, 0.99: 2.576}


def critical(level: float, df: Column) -> Column:
    """Two-sided critical value: that of the normal law, up to half as much again as degrees of freedom fall from 30."""
    base = CRITICAL[level]
    return F.when(df >= 30, F.lit(base)).otherwise(base * (1 + (30 - F.greatest(df, F.lit(1))) / 30.0 * 0.5))
