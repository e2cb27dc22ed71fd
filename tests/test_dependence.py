"""Special functions against exact values, mutual information against plain Python, geodesic steps."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vigil.functions import geo, special
from vigil.operators import dependence, spatial


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_gamma_and_digamma(spark):
    xs = [0.5, 1.0, 1.5, 3.0, 10.25, 1e3, 5e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(special.log_gamma(F.col("x"))).collect()]
    assert all(abs(g - math.lgamma(x)) <= 2e-15 * max(1, abs(math.lgamma(x)) * 4) + 4e-15 for g, x in zip(got, xs))
    harmonic = lambda n: float(sum(Fraction(1, i) for i in range(1, n))) - 0.57721566490153286
    assert all(abs(g - harmonic(n)) < 4e-15 * max(1, abs(harmonic(n))) * 4 for n, g in ((r[0], r[1]) for r in spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 400)], "n long").select("n", special.digamma(F.col("n"))).collect()))
    assert values(spark, special.digamma(F.lit(0)), special.log_gamma(F.lit(-1.0)), special.incomplete_beta(F.lit(1.5), F.lit(1.0), F.lit(1.0))) == [None, None, None]


def exact_p(r, n):
    """Two-sided p by the finite sums for t with a whole number of degrees (even: a polynomial, odd: with an arctangent)."""
    v = n - 2
    cos2, sin = 1 - r * r, abs(r)
    if v % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, v // 2):
            term *= cos2 * (2 * k - 1) / (2 * k)
            total += term
        return 1 - sin * total
    angle = math.asin(sin)
    if v == 1:
        return 1 - 2 * angle / math.pi
    term, total = math.sqrt(cos2), math.sqrt(cos2)
    for k in range(1, (v - 1) // 2):
        term *= cos2 * (2 * k) / (2 * k + 1)
        total += term
    return 1 - 2 / math.pi * (angle + sin * total)


def test_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 10, 57, 1000, 100001, 1_000_000) for r in (0.0, 1e-4, 0.003, 0.1, -0.5, 0.99)]
    got = [x[0] for x in spark.createDataFrame(cases, "r double, n long").coalesce(1).select(special.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert all(abs(g - exact_p(*c)) < 1e-10 for g, c in zip(got, cases)), [(c, g, exact_p(*c)) for g, c in zip(got, cases) if not abs(g - exact_p(*c)) < 1e-10]
    assert values(spark, special.correlation_p_value(F.lit(1.0), F.lit(5)), special.correlation_p_value(F.lit(0.5), F.lit(2))) == [0.0, None]


def plain_information(pairs, k):
    n = len(pairs)
    dev = [math.sqrt(sum((v - sum(c) / n) ** 2 for v in c) / n) for c in zip(*pairs)]
    pts = [(a / dev[0], b / dev[1]) for a, b in pairs]
    psi = lambda m: sum(1 / i for i in range(1, m)) - 0.57721566490153286
    total = 0.0
    for a, b in pts:
        r = sorted(max(abs(a - c), abs(b - d)) for c, d in pts)[k]
        near = [sum(abs(u - p[i]) < r or (r == 0 and u == p[i]) for p in pts) for i, u in ((0, a), (1, b))]
        total += psi(near[0]) + psi(near[1])
    return max(0.0, psi(n) + psi(k) - total / n)


@pytest.mark.parametrize("kind", ["linked", "apart", "copies"])
def test_mutual_information(spark, kind):
    rng = random.Random(5)
    rows = [(x, (x if kind == "linked" else rng.gauss(0, 1)) + rng.gauss(0, 0.3)) for x in (rng.gauss(0, 1) for _ in range(500))]
    if kind == "copies":
        rows = [(float(rng.randrange(6)), float(rng.randrange(5))) for _ in range(250)] + [(2.0, 2.0)] * 150 + rows[:100]
    df = spark.createDataFrame(rows + [(None, 1.0), (float("nan"), 2.0), (float("inf"), 0.0)], "a double, b double")
    assert dependence.mutual_information(df, "a", "b", ranges=7) == pytest.approx(plain_information(rows, 3), abs=1e-9)


def test_mutual_information_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double")
    assert dependence.mutual_information(df, "a", "b") is None and dependence.mutual_information(df.limit(0), "a", "b") is None


def test_counts_up_to(spark):
    v = spark.createDataFrame([(1.0, 2), (2.0, 1), (5.0, 7), (9.0, 1)], "v double, n long")
    a = spark.createDataFrame([(i, x, e) for i, (x, e) in enumerate([(0.0, True), (1.0, False), (1.0, True), (3.0, True), (5.0, False), (5.0, True), (8.9, False), (99.0, False)])], "i int, at double, with_equal boolean")
    for ranges in (1, 2, 5):
        assert [r.below for r in sorted(dependence.counts_up_to(v, a, ranges).collect())] == [0, 0, 2, 3, 3, 10, 10, 11]


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "a"), (3.0, 5.0, "a"), (4.0, None, "a"), (1.0, 1.0, "b")], "x double, y double, g string")
    got = {r.g: r for r in dependence.correlations(df, [("x", "y")], "g").collect()}
    assert got["a"].n == 3 and got["a"].p_value == pytest.approx(exact_p(got["a"].r, 3), abs=1e-12) and got["b"].p_value is None


def test_geodesic_grid(spark):
    pts = spatial.grid(spark, -23.7, -23.65, -46.8, -46.72, 500.0).collect()
    rows = {}
    for p in pts:
        rows.setdefault(p.latitude, []).append(p.longitude)
    lats = sorted(rows)
    assert len(lats) == 12 and lats[0] == -23.7 and lats[-1] <= -23.65 and all(min(r) == -46.8 and max(r) <= -46.72 for r in rows.values())
    pairs = [(a, b, a, c) for a, r in rows.items() for b, c in zip(sorted(r), sorted(r)[1:])] + [(a, -46.8, b, -46.8) for a, b in zip(lats, lats[1:])]
    m = [r[0] for r in spark.createDataFrame(pairs, "a double, b double, c double, d double").select(geo.geodesic_m(*map(F.col, "abcd"))).collect()]
    assert all(abs(x - 500) < 1e-3 for x in m)
    far = values(spark, *geo.geodesic_step(F.lit(-37.95103341666667), F.lit(144.42486788888888), F.lit(54972.271), 306.86815833333333))
    assert far[0] == pytest.approx(-37.65282113888889, abs=1e-7) and far[1] == pytest.approx(143.92649552777777, abs=1e-7)
    assert spatial.grid(spark, 89.9, 90.0, 0.0, 180.0, 1000.0).count() > 0
