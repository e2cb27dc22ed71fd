"""Special functions as column expressions: log-gamma, digamma, incomplete beta and the p-value of a correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the asymptotic series of log-gamma and digamma (Bernoulli numbers over 2k(2k-1) and 2k).
_GAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
#: Arguments are raised by this much before the series, so seven terms give full precision.
SHIFT = 10
#: Most steps of the continued fraction; it stops earlier once a step changes nothing.
STEPS = 4000


def _series(x: Column, terms, first: int) -> Column:
    inverse = 1 / (x * x)
    out = F.lit(0.0)
    for c in reversed(terms):
        out = out * inverse + F.lit(c)
    return out / x if first == 1 else out * inverse


def log_gamma(x: Column) -> Column:
    """ln of gamma for x > 0; null for others."""
    x = x.cast("double")
    low = sum((F.log(x + i) for i in range(1, SHIFT)), F.log(x))
    up = x + SHIFT
    return F.when(x > 0, (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + _series(up, _GAMMA, 1) - low)


def log_gamma_ratio(a: Column, b: Column) -> Column:
    """log_gamma(a + b) - log_gamma(a) for a, b > 0, exact where a is large and both are nearly the same."""
    a, b = a.cast("double"), b.cast("double")
    low = sum((F.log1p(b / (a + i)) for i in range(1, SHIFT)), F.log1p(b / a))
    up = a + SHIFT
    return (up - 0.5) * F.log1p(b / up) + b * F.log(up + b) - b + _series(up + b, _GAMMA, 1) - _series(up, _GAMMA, 1) - low


def digamma(x: Column) -> Column:
    """The derivative of ``log_gamma`` for x > 0; null for others."""
    x = x.cast("double")
    low = sum((1 / (x + i) for i in range(1, SHIFT)), 1 / x)
    up = x + SHIFT
    return F.when(x > 0, F.log(up) - 0.5 / up - _series(up, _DIGAMMA, 2) - low)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, two terms a step."""
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / away(1 + even * s["d"]), away(1 + even / s["c"])
        d2, c2 = 1 / away(1 + odd * d1), away(1 + odd / c1)
        h = s["h"] * (d1 * c1) * (d2 * c2)
        new = F.struct(c2.alias("c"), d2.alias("d"), h.alias("h"), (F.abs(d2 * c2 - 1) < 1e-16).alias("done"))
        return F.when(s["done"], s).otherwise(new)

    d = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function for a, b > 0 and x from 0 to 1; null elsewhere. ``rest``: 1 - x, where it is known better."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    rest = 1 - x if rest is None else rest.cast("double")
    powers = a * F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.log(x)) + b * F.when(x < 0.5, F.log1p(-x)).otherwise(F.log(rest))
    front = F.exp(F.when(a > b, log_gamma_ratio(a, b) - log_gamma(b)).otherwise(log_gamma_ratio(b, a) - log_gamma(a)) + powers)
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(rest, b, a) / b)
    return F.when((a > 0) & (b > 0), F.when(x == 0, 0.0).when(rest == 0, 1.0).when((x > 0) & (rest > 0), inside))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs under independence (t with n - 2 degrees); 0 for |r| = 1, null for n < 3.

    With t * t = r * r (n - 2) / (1 - r * r) the tail is that of the beta function at 1 - r * r. Near 1 the other end is
    computed, so a small p keeps its digits where r is large and p near 1 where r is small.
    """
    half = (n.cast("double") - 2) / 2
    return F.when((n >= 3) & (F.abs(r) <= 1), incomplete_beta(1 - r * r, half, F.lit(0.5), r * r))
