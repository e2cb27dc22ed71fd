"""Repeated ids, extreme numbers and shapes of very different size."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vigil.functions import geo, scalars
from vigil.operators import intervals, spatial


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def point(p):
    return float(p[0]), float(p[1])


def shapes(spark, rows):
    return spark.createDataFrame([(a, [[[*map(point, ring)] for ring in part] for part in parts]) for a, parts in rows], "area long, parts array<array<array<struct<x: double, y: double>>>>")


def test_points_that_share_an_id_have_their_own_area(spark):
    areas = shapes(spark, [(1, [[square(0, 0, 1)]]), (2, [[square(5, 0, 1)]])])
    points = spark.createDataFrame([(7, 0.5, 0.5), (7, 5.5, 0.5), (7, 9.0, 9.0), (8, None, 0.5)], "id long, x double, y double")
    assert sorted((r.id, r.x or -1, r.area) for r in spatial.with_areas(points, areas).collect()) == [(7, 0.5, 1), (7, 5.5, 2), (7, 9.0, None), (8, -1, None)]
    assert spatial.with_areas(points, areas.limit(0)).where("area is null").count() == 4


def test_one_huge_area_makes_few_cells(spark):
    rows = [(i, [[square(i % 200 * 0.01, i // 200 * 0.01, 0.001)]]) for i in range(2000)] + [(9999, [[square(-50, -50, 100)]])]
    boxes = spatial._boxes(shapes(spark, rows), "area")
    levels = spatial._levels(boxes)
    assert spatial._cells(boxes, levels).where("area = 9999 and at = level").count() <= 4 and spatial._cells(boxes, levels).count() <= 4 * len(levels) * 2001
    points = spark.createDataFrame([(1, 0.0505, 0.0005), (2, 0.0515, 0.0005), (3, 60.0, 0.0)], "id long, x double, y double")
    assert {r.id: r.area for r in spatial.with_areas(points, shapes(spark, rows)).collect()} == {1: 5, 2: 9999, 3: None}


def test_overlay_of_repeated_areas(spark):
    left = shapes(spark, [(1, [[square(0, 0, 1)]]), (1, [[square(2, 0, 1)]])])
    right = shapes(spark, [(9, [[square(-1, -1, 4, 2)]])])
    assert [tuple(r) for r in spatial.overlay(left, right).collect()] == [(1, 9, 2.0, 1.0, 0.25)]
    right = shapes(spark, [(9, [[square(-1, -1, 8, 4)]])])
    assert [tuple(r) for r in spatial.overlay(left, right).collect()] == [(1, 9, 2.0, 1.0, 2 / 32)]
    assert spatial.overlay(left.limit(0), right.limit(0)).count() == 0


def test_overlay_against_sampling(spark):
    import random

    rng = random.Random(8)

    def star(n, cx, cy):
        return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rng.uniform(0.3, 1.0)]]

    def inside(p, parts):
        odd = False
        for ring in (r for part in parts for r in part):
            for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
                if (y0 > p[1]) != (y1 > p[1]) and p[0] < x0 + (p[1] - y0) * (x1 - x0) / (y1 - y0):
                    odd = not odd
        return odd

    closed = lambda r: [*r, r[0]]
    one = [(i, [[closed(star(30, 0, 0)), closed([(x * 0.2, y * 0.2) for x, y in star(9, 0, 0)])], [square(2, 2, 0.5)]]) for i in range(3)]
    two = [(i, [[closed(star(25, 0.3, 0.2))[::-1]], [square(2.25, 2.25, 0.5)]]) for i in range(3)]
    got = {(r.a, r.b): r.area for r in spatial.overlay(shapes(spark, one), shapes(spark, two)).collect()}
    for i, a in one:
        for j, b in two:
            points = [(rng.uniform(-1.2, 3), rng.uniform(-1.2, 3)) for _ in range(20000)]
            share = sum(inside(p, a) and inside(p, b) for p in points) / len(points) * 4.2 * 4.2
            assert got[i, j] == pytest.approx(share, abs=0.12)


def test_spatial_operators_from_another_folder(tmp_path):
    """Workers need nothing of this package: the operators are expressions."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from vigil.operators import spatial
ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
a = s.createDataFrame([(1, ring)], "area long, ring array<struct<x: double, y: double>>")
print("result", spatial.overlay(a, a).collect()[0].area)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "result 1.0" in out.stdout, out.stderr[-2000:]


def test_idw_of_repeated_ids_and_rare_periods(spark):
    centres = spark.createDataFrame([(1, 0.0, 0.0), (1, 50.0, 50.0), (2, None, 1.0)], "id long, lat double, lon double")
    samples = spark.createDataFrame([("p", 1, 0.0, 1.0, 1.0), ("p", 2, 50.0, 51.0, 100.0)], "period string, trap long, lat double, lon double, value double")
    assert sorted((r.id, r.idw_value) for r in spatial.idw(centres, samples, k=1).collect()) == [(1, 1.0), (1, 100.0)]
    # A period that only the farthest of many sites has, and one with fewer samples than k.
    rows = [("often", i, i * 0.1, 0.0, float(i)) for i in range(400)] + [("rare", 399, 39.9, 0.0, 5.0), ("rare", 398, 39.8, 0.0, 7.0)]
    out = {r.period: r for r in spatial.idw(centres.limit(1), spark.createDataFrame(rows, samples.schema), k=3).collect()}
    assert out["rare"].n_used == 2 and out["rare"].traps == "398,399" and out["often"].traps == "0,1,2" and out["often"].idw_value == 0.0
    assert spatial.idw(centres, samples.limit(0)).count() == 0


def test_patches_that_repeat(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, v double")
    two = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (2, None, 1)], "id long, new_value double, at long")
    assert sorted(tuple(r) for r in intervals.patch(df, two, ["id"], "v", order="at").collect()) == [(1, 6.0), (2, 2.0)]
    same = two.withColumn("new_value", F.lit(9.0)).where("id = 1")
    assert sorted(tuple(r) for r in intervals.patch(df, same, ["id"], "v").collect()) == [(1, 9.0), (2, 2.0)]
    with pytest.raises(Exception, match="patches differ"):
        intervals.patch(df, two, ["id"], "v").collect()


def test_numbers_at_the_edges(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (inf, 1.0), (float("nan"), 1.0), (1.0, 0.0), (None, 1.0), (1e308, 1e-308)], "a double, b double")
    assert [r[0] for r in df.select(scalars.finite_or_zero(F.col("a"), F.col("b"))).collect()] == [0.5, 0, 0, 0, 0, 0]
    ids = spark.createDataFrame([("9007199254740993",), ("12.0",), ("1.2E1",), ("-0.5",), ("x",), (None,), ("-77.9",), ("1" * 30,)], "t string")
    assert [r[0] for r in ids.select(scalars.whole_id_text(F.col("t"))).collect()] == ["9007199254740993", "12", "12", "0", None, None, "-77", "1" * 30]


def test_geodesic_far_and_near(spark):
    rows = [(0.0, 0.0, 0.5, 179.7), (0.0, 0.0, 0.5, 179.5), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 1.0), (-37.9510334166667, 144.424867888889, -37.6528211388889, 143.926495527778)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic_m(*map(F.col, "abcd"))).collect()]
    assert got[0] is None and abs(got[1] - 19936288.579) < 1e-3  # published values: 19944127.421 and 19936288.579
    assert got[2] == 0 and abs(got[3] - 111319.491) < 1e-3 and abs(got[4] - 54972.271) < 1e-3


def test_centroid_of_parts_and_holes(spark):
    df = shapes(spark, [(1, [[square(0, 0, 4), square(1, 1, 2)[::-1]], [square(10, 0, 2)]])])
    cx, cy = geo.parts_centroid(F.col("parts"))
    r = df.select(cx.alias("x"), cy.alias("y"), geo.parts_area(F.col("parts")).alias("s")).first()
    assert (round(r.x, 9), round(r.y, 9), r.s) == (round((16 * 2 - 4 * 2 + 4 * 11) / 16, 9), round((16 * 2 - 4 * 2 + 4 * 1) / 16, 9), 16.0)


def test_centres_in_metres(spark):
    """The centre of projected parts with a hole is that of plain sums over their projected corners."""
    df = shapes(spark, [(1, [[square(-44.0, -20.0, 0.04), square(-43.99, -19.99, 0.01)], [square(-43.5, -20.5, 0.02)]])])
    x, y = geo.parts_centroid(geo.projected(F.col("parts")))
    lat, lon = geo.utm_to_degrees(F.col("x"), F.col("y"))
    got = df.select(geo.projected(F.col("parts")).alias("p"), x.alias("x"), y.alias("y")).select("p", "x", "y", lat.alias("lat"), lon.alias("lon")).first()

    def sums(ring):
        a = cx = cy = 0.0
        ox, oy = got.p[0][0][0].x, got.p[0][0][0].y
        for p, q in zip(ring, ring[1:]):
            px, py, qx, qy = p.x - ox, p.y - oy, q.x - ox, q.y - oy
            c = px * qy - qx * py
            a, cx, cy = a + c / 2, cx + (px + qx) * c / 6, cy + (py + qy) * c / 6
        return [v * (1 if a > 0 else -1) for v in (a, cx, cy)]

    rings = [(sums(r), 1 if k == 0 else -1) for part in got.p for k, r in enumerate(part)]
    a, cx, cy = (sum(s[i] * sign for s, sign in rings) for i in range(3))
    assert got.x - got.p[0][0][0].x == pytest.approx(cx / a, abs=1e-2) and got.y - got.p[0][0][0].y == pytest.approx(cy / a, abs=1e-2)
    assert -20.5 < got.lat < -19.9 and -44.0 < got.lon < -43.4
