"""Distances and projections as column expressions. Degrees in, kilometres or metres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# GRS80 ellipsoid and the UTM zone of the 45th meridian west, south.
A, FLAT = 6378137.0, 1 / 298.257222101
LON0, K0, EAST0, NORTH0 = -45.0, 0.9996, 500000.0, 10000000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular approximation."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(EARTH_KM) * F.sqrt(x * x + y * y)


def degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


METHODS = {"haversine": haversine_km, "planar": planar_km, "degrees": degrees}


def distance(method: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown distance {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](lat1, lon1, lat2, lon2)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid in metres: Vincenty's inverse formula, iterated until the longitude stands still (at most 200 steps).

    Points closer than rounding allows give 0. For nearly antipodal points the iteration doesn't settle; they give null.
    Expressions in the iteration aren't shared by Spark, so each intermediate value is bound by name: written out, a row takes milliseconds.
    """
    b = A * (1 - FLAT)

    def terms(f, lam, use):
        def arcs(t):
            p, q = f["cu2"] * t["sl"], f["cu1"] * f["su2"] - f["su1"] * f["cu2"] * t["cl"]
            return F.struct(F.sqrt(p * p + q * q).alias("ss"), (f["su1"] * f["su2"] + f["cu1"] * f["cu2"] * t["cl"]).alias("cs"), t["sl"].alias("sl"))

        def azimuth(t):
            sa = F.when(t["ss"] == 0, 0.0).otherwise(F.try_divide(f["cu1"] * f["cu2"] * t["sl"], t["ss"]))
            return F.struct(t["ss"].alias("ss"), t["cs"].alias("cs"), F.atan2(t["ss"], t["cs"]).alias("sig"), sa.alias("sa"))

        def middle(t):
            c2a = 1 - t["sa"] * t["sa"]
            c2m = F.when(c2a == 0, 0.0).otherwise(t["cs"] - F.try_divide(2 * f["su1"] * f["su2"], c2a))
            return F.struct(*[t[c].alias(c) for c in ("ss", "cs", "sig", "sa")], c2a.alias("c2a"), c2m.alias("c2m"))

        turned = F.struct(F.sin(lam).alias("sl"), F.cos(lam).alias("cl"))
        return _with(turned, lambda t: _with(arcs(t), lambda u: _with(azimuth(u), lambda v: _with(middle(v), use))))

    def step(f, lam):
        def after(t):
            ss, cs, c2m = t["ss"], t["cs"], t["c2m"]
            c = FLAT / 16 * t["c2a"] * (4 + FLAT * (4 - 3 * t["c2a"]))
            return _with(c, lambda c: f["length"] + (1 - c) * FLAT * t["sa"] * (t["sig"] + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))))

        return terms(f, lam, after)

    def finish(f, lam):
        def metres(t):
            ss, cs, c2m = t["ss"], t["cs"], t["c2m"]

            def scaled(u):
                big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                delta = lambda s: s * ss * (c2m + s / 4 * (cs * (2 * c2m * c2m - 1) - s / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
                return _with(small, lambda s: b * big * (t["sig"] - delta(s)))

            return _with(t["c2a"] * ((A * A - b * b) / (b * b)), scaled)

        return terms(f, lam, metres)

    def settle(f, state):
        moved = _with(step(f, state["lam"]), lambda after: F.struct(after.alias("lam"), (F.abs(after - state["lam"]) < 1e-13).alias("done")))
        return F.when(state["done"], state).otherwise(moved)

    def iterated(f):
        start = F.struct(f["length"].alias("lam"), F.lit(False).alias("done"))
        end = lambda state: F.when(state["done"] & (F.abs(state["lam"]) <= F.pi()), finish(f, state["lam"]))
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, lambda state, _: settle(f, state), end)

    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    reduced = F.struct(u1.alias("u1"), u2.alias("u2"), F.radians(lon2 - lon1).alias("length"))
    fixed = lambda r: F.struct(F.sin(r["u1"]).alias("su1"), F.cos(r["u1"]).alias("cu1"), F.sin(r["u2"]).alias("su2"), F.cos(r["u2"]).alias("cu2"), r["length"].alias("length"))
    return _with(reduced, lambda r: _with(fixed(r), iterated))


def geodesic_step(lat: Column, lon: Column, metres: Column, bearing: float) -> tuple[Column, Column]:
    """Latitude and longitude reached on the ellipsoid by going ``metres`` at a bearing in degrees: Vincenty's direct formula."""
    b, az = A * (1 - FLAT), math.radians(bearing)
    tu = (1 - FLAT) * F.tan(F.radians(lat))
    cu = 1 / F.sqrt(1 + tu * tu)
    su = tu * cu
    sig1 = F.atan2(tu, F.lit(math.cos(az)))
    sa = cu * math.sin(az)
    c2a = 1 - sa * sa
    u = c2a * ((A * A - b * b) / (b * b))
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    first = metres / (b * big)

    def step(sig, _):
        c2m, ss, cs = F.cos(2 * sig1 + sig), F.sin(sig), F.cos(sig)
        return first + small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))

    def ends(sig):
        c2m, ss, cs = F.cos(2 * sig1 + sig), F.sin(sig), F.cos(sig)
        x = su * ss - cu * cs * math.cos(az)
        lat2 = F.atan2(su * cs + cu * ss * math.cos(az), (1 - FLAT) * F.sqrt(sa * sa + x * x))
        lam = F.atan2(ss * math.sin(az), cu * cs - su * ss * math.cos(az))
        c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
        turn = lam - (1 - c) * FLAT * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
        return F.struct(F.degrees(lat2).alias("lat"), (lon + F.degrees(turn)).alias("lon"))

    reached = F.aggregate(F.sequence(F.lit(1), F.lit(8)), first, step, ends)
    return reached["lat"], reached["lon"]


# Krueger's series in the third flattening, to the fourth order (Karney, 2011).
_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def utm_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of zone coordinates in metres."""
    xi, eta = (y - NORTH0) / (K0 * _RECT), (x - EAST0) / (K0 * _RECT)
    xi1 = xi - sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(_BETA)), F.lit(0.0))
    eta1 = eta - sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(_BETA)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((c * F.sin(2 * (j + 1) * chi) for j, c in enumerate(_DELTA)), F.lit(0.0))
    return F.degrees(lat), F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def zone_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """As ``utm_to_degrees`` for tables that write a place they don't know as 0: without x no latitude, without y no longitude."""
    lat, lon = utm_to_degrees(x, y)
    return F.when(x != 0, lat), F.when(y != 0, lon)


def degrees_to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    c = 2 * math.sqrt(_N) / (1 + _N)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - LON0)
    z = _atanh(s) - c * _atanh(c * s)
    t = F.sinh(z)
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA)), F.lit(0.0))
    return EAST0 + K0 * _RECT * x, NORTH0 + K0 * _RECT * y


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y); the sign is dropped."""
    return F.abs(_cross_sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    twice = _cross_sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    cx = _cross_sum(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    cy = _cross_sum(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    return F.try_divide(cx, 3 * twice), F.try_divide(cy, 3 * twice)


def ring_sign(ring: Column, number: Column) -> Column:
    """1 or -1, so that the outer ring (number 0) of a polygon counts up and holes down whatever way they are drawn."""
    turn = _cross_sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.signum(turn) * F.when(number == 0, 1.0).otherwise(-1.0)


def parts_area(parts: Column) -> Column:
    """Area of polygons of rings, the first the outer one, the others holes."""
    one = lambda rings: F.aggregate(F.transform(rings, lambda r, k: ring_area(r) * F.when(k == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(parts, one), F.lit(0.0), lambda s, v: s + v)


def parts_centroid(parts: Column) -> tuple[Column, Column]:
    """Centre of gravity of polygons with holes; null where they have no area."""
    rings = F.flatten(F.transform(parts, lambda part: F.transform(part, lambda r, k: F.struct(r.alias("r"), ring_sign(r, k).alias("s")))))

    def moment(term):
        return F.aggregate(rings, F.lit(0.0), lambda acc, x: acc + x["s"] * _cross_sum(x["r"], term))

    twice = moment(lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    cx = moment(lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    cy = moment(lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    return F.try_divide(cx, F.nullif(3 * twice, F.lit(0.0))), F.try_divide(cy, F.nullif(3 * twice, F.lit(0.0)))


def signed_edges(parts: Column) -> Column:
    """Edges of polygons from left to right (x0, y0, x1, y1) with the sign of the strip under each (s); upright ones have no strip."""

    def edge(e, sign):
        p, q = e["p"], e["q"]
        right = q["x"] > p["x"]
        pick = lambda a, b: F.when(right, a).otherwise(b)
        return F.struct(pick(p["x"], q["x"]).alias("x0"), pick(p["y"], q["y"]).alias("y0"), pick(q["x"], p["x"]).alias("x1"), pick(q["y"], p["y"]).alias("y1"), (sign * pick(F.lit(-1.0), F.lit(1.0))).alias("s"))

    def ring(r, k):
        sign = ring_sign(r, k)
        return F.transform(F.filter(_edges(r), lambda e: e["p"]["x"] != e["q"]["x"]), lambda e: edge(e, sign))

    return F.flatten(F.transform(parts, lambda part: F.flatten(F.transform(part, ring))))


def common_area(one: Column, two: Column) -> Column:
    """Area that two polygons, given by ``signed_edges``, share: the sum over pairs of edges of the signed area under both.

    Strips reach down to the lower of the two lowest points, so heights stay small against the shapes.
    """
    low = F.least(*[F.array_min(F.transform(e, lambda v: F.least(v["y0"], v["y1"]))) for e in (one, two)])

    def under(e, f):
        left, right = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])
        at = lambda v, x: v["y0"] + (v["y1"] - v["y0"]) * ((x - v["x0"]) / (v["x1"] - v["x0"])) - low
        a0, a1, b0, b1 = at(e, left), at(e, right), at(f, left), at(f, right)
        d0, d1 = a0 - b0, a1 - b1
        t = d0 / (d0 - d1)
        cross = a0 + t * (a1 - a0)
        lower = F.when(d0 * d1 < 0, t * (F.least(a0, b0) + cross) + (1 - t) * (cross + F.least(a1, b1))).otherwise(F.least(a0, b0) + F.least(a1, b1))
        return F.when(left < right, e["s"] * f["s"] * (right - left) * lower / 2).otherwise(0.0)

    return F.greatest(F.lit(0.0), F.aggregate(one, F.lit(0.0), lambda acc, e: acc + F.aggregate(two, F.lit(0.0), lambda s, f: s + under(e, f))))


def projected(parts: Column) -> Column:
    """Polygons of (longitude, latitude) in metres of the zone."""

    def point(p):
        x, y = degrees_to_utm(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def _edges(ring: Column) -> Column:
    return F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))


def _cross_sum(ring: Column, term) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + term(e["p"], e["q"]))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing number of a closed ring; points on the boundary are outside."""

    def crosses(e):
        p, q = e["p"], e["q"]
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    edges = _edges(ring)
    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd & ~on_ring(x, y, ring)


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in the area of several rings (parts and holes): inside an odd number of them, on no boundary."""
    odd = F.aggregate(rings, F.lit(False), lambda s, ring: s != point_in_ring(x, y, ring))
    return odd & ~F.exists(rings, lambda ring: on_ring(x, y, ring))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies on the boundary of a closed ring."""

    def touches(e):
        p, q = e["p"], e["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(_edges(ring), touches)
