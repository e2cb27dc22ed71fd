"""Exact small cases of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vigil.functions import calendar as cal
from vigil.functions import geo, scalars
from vigil.operators import features, intervals, quality, rates, series, spatial
from vigil.sources import readers
from vigil.streaming import events


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_calendar_every_day(spark):
    first, last = day("2000-01-01"), day("2039-12-31")
    df = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    got = df.select("d", cal.epidemic_year(F.col("d")).alias("y"), cal.epidemic_week(F.col("d")).alias("w"), cal.week_label(F.col("d")).alias("l")).collect()

    def start(y):
        june = dt.date(y, 6, 1)
        return june - dt.timedelta(days=(june.weekday() + 1) % 7)

    for r in got:
        y = r.d.year if r.d >= start(r.d.year) else r.d.year - 1
        w = (r.d - start(y)).days // 7 + 1
        assert (r.y, r.w) == (y, w)
        assert r.l == f"{y}_{(y + 1) % 100:02d}W{w:02d}"
    long = {r.y for r in got if r.w == 53}
    assert {2002, 2007, 2013, 2019, 2024, 2030, 2035} <= long and max(r.w for r in got) == 53


def test_labels(spark):
    df = spark.createDataFrame([("2020_21W05",), ("2020_22W05",), ("2020_21W54",), ("x",), (None,), ("1999_00W53",)], "l string")
    assert [r[0] for r in df.select(cal.is_label(F.col("l"))).collect()] == [True, False, False, False, False, True]
    assert df.select(cal.biweek_of_label(F.lit("1999_00W53"))).first()[0] == "1999_00W54"
    assert [r.epidemic_date for r in cal.week_spine(spark, "2007_08W52", "2008_09W02").orderBy("epidemic_date").collect()] == ["2007_08W52", "2007_08W53", "2008_09W01", "2008_09W02"]
    assert spark.range(1).select(cal.compact_iso_label(F.lit("2020W5")), cal.iso_label_to_date(F.lit("2020-W53")), cal.hour_text(F.lit(930))).first() == ("202005", day("2020-12-28"), "09:30")
    assert cal.week_days(spark, 2013).count() == 53 * 7


def exposure(spark, *items):
    return spark.createDataFrame([(a, day(b), day(c), float(v)) for a, b, c, v in items], "trap string, dt_instal date, dt_col date, eggs double")


def test_daily_spread(spark):
    df = exposure(spark, ("A", "2023-01-01", "2023-01-03", 6), ("B", "2023-01-05", "2023-01-07", 9), ("A", "2023-01-10", "2023-01-12", 12), ("A", "2023-02-01", "2023-02-01", 5))
    got = {(r.trap, str(r.day)): r.eggs for r in intervals.daily_spread(df).collect()}
    assert got == {("A", "2023-01-01"): 3.0, ("A", "2023-01-02"): 3.0, ("B", "2023-01-05"): 4.5, ("B", "2023-01-06"): 4.5, ("A", "2023-01-10"): 6.0, ("A", "2023-01-11"): 6.0}
    over = intervals.daily_spread(exposure(spark, ("A", "2023-01-01", "2023-01-03", 6), ("A", "2023-01-02", "2023-01-04", 4)))
    assert [r.eggs for r in over.orderBy("day").collect()] == [3.0, 5.0, 2.0]
    leap = intervals.daily_spread(exposure(spark, ("A", "2020-01-01", "2021-01-01", 366)))
    assert leap.count() == 366 and leap.agg(F.max("eggs")).first()[0] == 1.0
    zero = intervals.daily_spread(exposure(spark, ("A", "2023-01-01", "2023-01-03", 0)))
    assert [r.eggs for r in zero.collect()] == [0.0, 0.0]
    assert intervals.daily_spread(df.limit(0)).count() == 0
    dense = intervals.dense_days(intervals.daily_spread(df).groupBy("day").agg(F.sum("eggs").alias("n")), fill=0.0)
    assert dense.count() == 11


@pytest.mark.parametrize(
    "items,expected",
    [
        ([("1", "01-01", "01-03", "A1"), ("1", "01-02", "01-04", "A2")], [("A1", "A2")]),
        ([("1", "01-01", "01-03", "A1"), ("1", "01-03", "01-05", "A2")], [("A1", "A2")]),
        ([("1", "01-01", "01-03", "A1"), ("1", "01-04", "01-06", "A2")], []),
        ([("1", "01-01", "01-02", "A1"), ("1", "01-02", "01-03", "A2"), ("1", "01-03", "01-04", "A3")], [("A1", "A2"), ("A2", "A3")]),
        ([("1", "01-01", "01-03", "A1"), ("1", "01-10", "01-12", "A2"), ("1", "01-05", "01-07", "A3")], []),
        ([("1", "01-01", "01-03", "A1"), ("2", "01-01", "01-03", "B1")], []),
    ],
)
def test_overlaps(spark, items, expected):
    df = spark.createDataFrame([(t, day("2023-" + a), day("2023-" + b), s) for t, a, b, s in items], "trap string, dt_instal date, dt_col date, sample string")
    assert rows(intervals.overlaps(df), "first", "second") == expected


def test_date_repair(spark):
    data = [
        ("a", "1", "2023-01-01", "2023-01-01", 4.0), ("b", "2", "2023-01-10", "2023-01-05", 4.0), ("c", "3", "2023-01-10", None, 7.0), ("d", "4", "2023-01-01", "2023-03-01", 7.0),
        ("e", "5", "2023-01-01", "2023-01-08", None), ("f", "6", "2023-01-01", "2023-01-09", 8.0), ("g", "6", "2023-01-08", "2023-01-16", 8.0),
    ]
    df = spark.createDataFrame([(s, t, day(a), b and day(b), n) for s, t, a, b, n in data], "sample string, trap string, dt_instal date, dt_col date, novos double")
    got = {r["sample"]: (str(r.dt_col), r.days_expo) for r in intervals.repair_dates(df).collect()}
    assert got == {"a": ("2023-01-08", 7), "b": ("2023-01-17", 7), "c": ("2023-01-17", 7), "d": ("2023-01-08", 7), "f": ("2023-01-08", 7), "g": ("2023-01-16", 8)}


def test_population_line(spark):
    df = spark.createDataFrame([("s_decrease", 514, 467), ("s_increase", 259, 448)], "sector_id string, population_2010 long, population_2022 long")
    weeks = spark.createDataFrame([("2006_07W32",), ("2010_11W01",), ("2022_23W01",), ("2024_25W44",)], "epidemic_date string")
    got = {(r.sector_id, r.epidemic_date): r.population for r in rates.population_line(df, weeks).collect()}
    assert got["s_decrease", "2010_11W01"] == 514 and got["s_increase", "2022_23W01"] == 448
    assert got["s_decrease", "2006_07W32"] > 514 and got["s_increase", "2024_25W44"] > 448
    assert rates.population_line(df, weeks.limit(0)).count() == 0


def test_empirical_bayes(spark):
    e, b = [0, 3, 1, 50, 2, 0], [100, 120, 900, 20000, 0, 50]
    df = spark.createDataFrame(list(zip(range(6), e, b)), "i long, case_count long, population long")
    got = {r.i: r.eb_rate_per_1000 for r in rates.empirical_bayes(df).collect()}
    ok = [k for k in range(6) if b[k] > 0]
    m = sum(e[k] for k in ok) / sum(b[k] for k in ok)
    s2 = sum(b[k] * (e[k] / b[k] - m) ** 2 for k in ok) / sum(b[k] for k in ok)
    a = max(0.0, s2 - m / (sum(b[k] for k in ok) / len(ok)))
    for k in ok:
        w = a / (a + m / b[k])
        assert math.isclose(got[k], (w * e[k] / b[k] + (1 - w) * m) * 1000, rel_tol=1e-9, abs_tol=1e-12)
    assert got[4] == 0.0
    assert {r.eb_rate_per_1000 for r in rates.empirical_bayes(df.withColumn("population", F.lit(0))).collect()} == {0.0}
    with pytest.raises(ValueError):
        rates.require_columns(df, ["nope"])


def test_redistribute_classes(spark):
    links = spark.createDataFrame([("a", "x", 0.9, 100.0), ("b", "y", 0.5, 100.0), ("b", "z", 0.5, 100.0), ("c", "z", 1.0, 40.0), ("d", "w", 1.0, None)], "source string, target string, fraction double, population double")
    got = {r.target: (r.population, r.conversion) for r in rates.redistribute(links).collect()}
    assert got == {"x": (90, "maintained"), "y": (50, "subdivided"), "z": (90, "aggregated")}


def test_series(spark):
    df = spark.createDataFrame([(f"{i:02d}", float(v) if v is not None else None) for i, v in enumerate([None, 2, None, None, 8, None])], "label string, y double")
    got = series.fill(df, "y").orderBy("label").collect()
    assert [r.linear for r in got] == [None, 2, 4, 6, 8, 8]
    assert [r.bfill for r in got] == [2, 2, 8, 8, 8, None]
    g = series.group_series(df, "y", 2, 1).orderBy("bucket").collect()
    assert [(r.bucket, r.y) for r in g] == [(-1, 0.0), (0, 2.0), (1, 8.0), (2, 0.0)]
    with pytest.raises(ValueError):
        series.group_series(df, "y", 2, operation="mode")
    x = [1, 5, 2, 8, 3, 9, 4, 7, 6, 10, 2, 5]
    pair = spark.createDataFrame([(f"{i:02d}", float(x[i - 2]) if i > 1 else 0.0, float(x[i])) for i in range(12)], "label string, x double, y double")
    best = series.best_lag(series.lagged_correlation(pair, "x", "y", 3)).first()
    assert best.lag == 2 and best["corr"] > 0.999  # x follows y by two steps
    flat = pair.withColumn("y", F.lit(1.0))
    assert series.best_lag(series.lagged_correlation(flat, "x", "y", 2)).count() == 0
    assert rows(series.normalise(pair.limit(1), "x", "zscore"), "zscore") == [(None,)]


def test_mutual_information(spark):
    import random

    random.seed(1)
    data = [(random.random(), random.random()) for _ in range(300)]
    data = [(a, a if i % 2 else b) for i, (a, b) in enumerate(data)]
    got = series.mutual_information(spark.createDataFrame(data, "x double, y double"), "x", "y", 5).first()[0]
    lo = [min(v[k] for v in data) for k in (0, 1)]
    hi = [max(v[k] for v in data) for k in (0, 1)]
    cells = [tuple(min(4, int((v[k] - lo[k]) * 5 / (hi[k] - lo[k]))) for k in (0, 1)) for v in data]
    n = len(cells)
    want = sum(cells.count(c) / n * math.log(cells.count(c) * n / (sum(x[0] == c[0] for x in cells) * sum(x[1] == c[1] for x in cells))) for c in set(cells))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (None,)], "x double")
    assert [tuple(r) for r in df.select(scalars.half_up(F.col("x")), scalars.half_even(F.col("x")), scalars.clip(F.col("x"), 0.0, 2.0)).collect()] == [(3, 2.0, 2.0), (-2, -2.0, 0.0), (None, None, None)]
    bins = spark.createDataFrame([(2.65,), (2.66,), (5.0,), (5.1,), (None,)], "x double").select(scalars.right_closed_bins(F.col("x"), [2.65, 5.0]).alias("b"))
    assert [r.b for r in bins.collect()] == [0, 1, 1, 2, None]
    one = spark.range(1)
    assert one.select(scalars.comma_decimal(F.lit("1,5")), scalars.comma_decimal(F.lit("x")), scalars.id_text(F.lit("12.0")), scalars.row_mean(F.lit(None).cast("double"), F.lit(4.0)), scalars.row_sum(F.lit(None).cast("double"))).first() == (1.5, None, "12", 4.0, 0.0)
    assert one.select(*scalars.split_pair(F.lit("-19.9, -43.9"))).first() == (-19.9, -43.9)


def test_geography(spark):
    one = spark.range(1)
    # One degree of a meridian, and a published pair on the GRS80 ellipsoid's near twin.
    km, m = one.select(geo.haversine_km(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)]), geo.geodesic_m(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)])).first()
    assert abs(km - 111.1949) < 1e-3 and abs(m - 110574.3886) < 0.01
    quarter = one.select(geo.geodesic_m(*[F.lit(v) for v in (0.0, 0.0, 0.0, 90.0)])).first()[0]
    assert abs(quarter - math.pi / 2 * 6378137) < 0.01
    assert one.select(geo.geodesic_m(*[F.lit(1.0)] * 4)).first()[0] == 0.0
    x, y = geo.degrees_to_utm(F.lit(-19.92), F.lit(-45.0))
    got = one.select(x, y).first()
    assert abs(got[0] - 500000) < 1e-6 and 7.7e6 < got[1] < 7.9e6
    with pytest.raises(ValueError):
        geo.distance("taxi", *[F.lit(0.0)] * 4)
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0))])
    inside = lambda a, b: geo.point_in_ring(F.lit(a), F.lit(b), ring)
    assert one.select(inside(1.0, 1.0), inside(2.0, 3.0), inside(4.0, 1.0), inside(5.0, 1.0), inside(2.0, 0.0)).first() == (True, False, False, False, False)
    assert one.select(geo.ring_area(ring)).first()[0] == 10.0


def test_nearest(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, None, 1.0), (4, -0.01, 0.0)], "id long, lat double, lon double")
    s = spark.createDataFrame([(9, 0.0, 0.01), (8, 0.0, -0.01), (7, 9.0, 10.0), (6, None, None)], "site long, lat double, lon double")
    got = {r.id: r.site for r in spatial.nearest(p, s).collect()}
    assert got == {1: 8, 2: 7, 3: None, 4: 8}
    assert {r.site for r in spatial.nearest(p, s.limit(0)).collect()} == {None}


def test_nearest_of_repeated_ids_far_points_and_the_date_line(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 10.0), (2, 0.0, 179.99), (3, 89.9, 100.0), (4, -60.0, -170.0)], "id long, lat double, lon double")
    s = spark.createDataFrame([(7, 0.0, 0.01), (8, 10.5, 10.5), (5, 0.0, -179.99), (6, 89.9, -80.0)], "site long, lat double, lon double")
    got = sorted((r.id, r.lat, r.site) for r in spatial.nearest(p, s).collect())
    assert got == [(1, 0.0, 7), (1, 10.0, 8), (2, 0.0, 5), (3, 89.9, 6), (4, -60.0, 5)]


def test_nearest_and_idw_by_brute_force(spark):
    import math
    import random

    rng = random.Random(2)
    place = lambda: (rng.uniform(-80, 80), rng.uniform(-180, 180)) if rng.random() < 0.3 else (rng.uniform(-20.1, -19.9), rng.uniform(-44, -43.9))
    sites, points = [(i, *place()) for i in range(150)], [(i, *place()) for i in range(200)]

    def km(a, b):
        (_, p, u), (_, r, v) = a, b
        h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(v - u) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    got = {r.id: r.site for r in spatial.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(sites, "site long, lat double, lon double")).collect()}
    assert got == {p[0]: min(sites, key=lambda s: (km(p, s), s[0]))[0] for p in points}
    samples = [(f"p{i % 3}", i, *place(), float(i % 11)) for i in range(90)] + [("p9", 1, 0.0, 0.0, 2.0)]
    rows = spatial.idw(spark.createDataFrame(points[:20], "id long, lat double, lon double"), spark.createDataFrame(samples, "period string, trap long, lat double, lon double, value double"), k=4).collect()
    assert len(rows) == 20 * 4
    for r in rows:
        _, la, lo = points[r.id]
        near = sorted((math.hypot(s[2] - la, s[3] - lo), s[1], s[4]) for s in samples if s[0] == r.period)[:4]
        assert r.traps == ",".join(str(n[1]) for n in near) and abs(r.idw_value - sum(n[2] / n[0] ** 2 for n in near) / sum(1 / n[0] ** 2 for n in near)) < 1e-9


def test_overlay_of_any_shape(spark):
    def area(key, *polygons):
        return (key, [[[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in part] for part in polygons])

    kind = "area string, parts array<array<array<struct<x:double,y:double>>>>"
    c_shape = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (4, 3), (4, 4), (0, 4)]
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 4), (4, 4), (4, 2)]
    left = spark.createDataFrame([area("box", [[(2, 0), (4, 0), (4, 4), (2, 4)]]), area("frame", [square, hole]), area("two", [[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(3, 3), (4, 3), (4, 4), (3, 4)]])], kind)
    right = spark.createDataFrame([area("c", [c_shape]), area("c turned", [c_shape[::-1]]), area("inner", [[(1, 1), (5, 1), (5, 5), (1, 5)]])], kind)
    got = {(r.a, r.b): (round(r.area, 9), round(r.of_a, 9), round(r.of_b, 9)) for r in spatial.overlay(left, right).collect()}
    assert got["box", "c"] == got["box", "c turned"] == (4.0, 0.5, 0.4)
    assert got["frame", "inner"] == (12.0, 0.125, 0.75) and got["two", "c"] == (2.0, 1.0, 0.2) and got["two", "inner"] == (1.0, 0.5, 0.0625)
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 5.0, 5.0), (3, 2.0, 3.0), (4, 0.5, 0.5)], "id long, x double, y double")
    inside = {r.id: r.area for r in spatial.with_areas(points, left.where("area = 'frame'")).collect()}
    assert inside == {1: None, 2: "frame", 3: None, 4: "frame"}
    with pytest.raises(ValueError):
        spatial.clip_ring([(0, 0), (1, 0), (1, 1)], c_shape)


def test_clusters_with_centres(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.0, 0.02), (5, 5.0, 5.0)], "site long, lat double, lon double")
    got = {r.cluster: (r.n, r.lat, round(r.lon, 9)) for r in spatial.cluster_table(s, 1.5, 2).collect()}
    assert got == {1: (3, 0.0, 0.01), -1: (1, 5.0, 5.0)}


def test_geojson_keeps_parts_and_holes(spark, tmp_path):
    import json

    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    features = [{"type": "Feature", "properties": {"area": 1}, "geometry": {"type": "Polygon", "coordinates": [ring(0.0, 9.0), ring(2.0, 4.0)]}}, {"type": "Feature", "properties": {"area": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring(0.0, 1.0)], [ring(5.0, 6.0)]]}}]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    g = readers.read_geojson(spark, str(tmp_path / "p.json"), "area int")
    assert {r.area: [len(p) for p in r.parts] for r in g.collect()} == {1: [2], 2: [1, 1]}
    readers.write_geojson(g, str(tmp_path / "out"), collection=True)
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))
    assert len(json.loads(text)["features"]) == 2 and json.loads(text)["type"] == "FeatureCollection"
    back = readers.read_geojson(spark, str(tmp_path / "out"), "area int")
    assert {r.area: r.parts for r in back.collect()} == {r.area: r.parts for r in g.collect()}


def test_idw_and_clip(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, lat double, lon double")
    s = spark.createDataFrame([("p", "a", 0.0, 0.0, 5.0), ("p", "b", 2.0, 0.0, 1.0), ("p", "b", 2.0, 0.0, 2.0), ("p", None, 1.0, 1.0, 9.0)], "period string, trap string, lat double, lon double, value double")
    got = {r.id: (r.idw_value, r.n_used, r.traps) for r in spatial.idw(c, s).collect()}
    assert got == {1: (5.0, 2, "a,b"), 2: (4.0, 2, "a,b")}
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert spatial.polygon_area(spatial.clip_ring([(1, 1), (3, 1), (3, 3), (1, 3)], square)) == 1
    assert spatial.clip_ring([(5, 5), (6, 5), (6, 6)], square) == []
    assert spatial.polygon_area(spatial.clip_ring([(1, 1), (3, 1), (3, 3), (1, 3)], square[::-1])) == 1


def test_grid_and_order(spark):
    g = spatial.grid(spark, -23.6, -23.5, -46.7, -46.6, 1000.0).collect()
    assert all(-23.6 <= r.latitude <= -23.5 and -46.7 <= r.longitude <= -46.6 for r in g) and len({tuple(r) for r in g}) == len(g)
    assert 0.5 * 112 < len(g) < 1.5 * 135
    for bad in ((1.0, 0.0, 0.0, 1.0, 5.0), (0.0, 1.0, 0.0, 1.0, 0.0), (0.0, 1.0, 0.0, 200.0, 5.0), (0.0, float("nan"), 0.0, 1.0, 5.0), (0.0, 1.0, 0.0, 1.0, True)):
        with pytest.raises(ValueError):
            spatial.grid(spark, *bad)
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 3.0), (3, 0.0, 1.0)], "site long, lat double, lon double")
    assert spatial.greedy_order(s) == [1, 3, 2]


def test_dbscan(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.0, 0.02), (4, 0.0, 0.03), (5, 5.0, 5.0), (6, 0.0, 0.0395)], "site long, lat double, lon double")
    assert {r.site: r.cluster for r in spatial.dbscan(s, 1.2, 3).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: -1, 6: 2}
    assert {r.cluster for r in spatial.dbscan(s, 1e-6, 2).collect()} == {-1}


def test_feature_matrix(spark):
    d0 = day("2023-01-01")
    values = {("a", w): float(w) for w in range(10)} | {("b", w): float(100 + w) for w in range(0, 10, 2)}
    s = spark.createDataFrame([(t, w, d0 + dt.timedelta(days=7 * w), v) for (t, w), v in values.items()], "trap string, week int, day date, value double")
    near = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1)], "trap string, other string, rank int")
    m = features.neighbour_lag_matrix(s, s.select("week").distinct(), near, 2, 2)
    got = {(r.trap, r.week): [(f.other, f["values"], f.days) for f in r.features] for r in m.collect()}
    assert got["a", 5] == [("a", [4.0, 3.0], [7, 14]), ("b", [104.0, 102.0], [7, 21])]
    assert ("a", 1) not in got and ("a", 3) in got


def test_models(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), float(i > 10), float(i % 3)) for i in range(24)], "x double, y double, c double, z double")
    fit = features.linear_fit(df, "x", "y").first()
    assert math.isclose(fit.slope, 2) and math.isclose(fit.intercept, 1) and math.isclose(fit.r2, 1)
    m = features.regression_metrics(df.withColumn("p", F.col("y") + 1), "y", "p").first()
    assert math.isclose(m.rmse, 1) and math.isclose(m.mae, 1)
    model = features.tree_model(df, ["x", "z"], "y")
    imp = features.permutation_importance(df, model, ["x", "z"], "y", repeats=2).collect()
    assert imp[0].feature == "x" and imp[0].importance > 0
    assert features.forward_stepwise(df.withColumn("c", F.when(F.col("x") == 9, 1.0).otherwise(F.col("c"))), ["z", "x"], "c")[0] == "x"


def test_quality(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "a"), (1, None, "a")], "k long, v long, c string")
    assert rows(quality.profile(df), "column", "nulls") == [("c", 0), ("k", 0), ("v", 2)]
    assert quality.constant_columns(df) == ["k", "c"]
    assert quality.duplicates(df).first()[0] == 1
    assert rows(quality.violations(df, {"v": F.col("v") > 0, "k": F.col("k") == 1}), "rule", "violations") == [("k", 0), ("v", 2)]


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("note\nid;v;n\n1;1,5;é\n2;x;b\n".encode("latin-1"))
    got = readers.read_csv(spark, str(p), "id int, v double, n string", sep=";", encoding="ISO-8859-1", skip_rows=1, comma_decimals=["v"])
    assert rows(got, "id", "n") == [(1, "é"), (2, "b")] and {r.id: r.v for r in got.collect()} == {1: 1.5, 2: None}
    q = tmp_path / "b.csv"
    q.write_bytes("id,n\n1,é\n".encode("latin-1"))
    assert readers.read_csv_any(spark, str(q), "id int, n string").first().n == "é"
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "x.csv").write_text("id\n1\n")
    (folder / "y.csv").write_text("id\n2\n")
    assert rows(readers.read_csv_folder(spark, str(folder), "id int"), "id", "source_file") == [(1, "x"), (2, "y")]
    ring = "[[[0,0],[1,0],[1,1],[0,0]]]"
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"area":7},"geometry":{"type":"Polygon","coordinates":' + ring + "}}]}")
    g = readers.read_geojson(spark, str(tmp_path / "g.json"), "area int")
    assert g.first().area == 7 and len(g.first().ring) == 4
    assert '"coordinates":[[[0.0,0.0]' in readers.geojson_lines(g).first().value
    payload = spark.createDataFrame([('{"data":[{"data":[]},{"data":[[0,1.5],[60000,2]]}]}',)], "j string")
    assert [(str(r.time), r.value) for r in readers.read_series_payload(payload, "j").orderBy("time").collect()] == [("1970-01-01 00:00:00", 1.5), ("1970-01-01 00:01:00", 2.0)]
    out = str(tmp_path / "once")
    assert readers.ingest_once(spark, out, lambda: got).count() == 2
    assert readers.ingest_once(spark, out, lambda: 1 / 0).count() == 2
    readers.write_csv(got, str(tmp_path / "c"))
    readers.write_parquet(got.withColumn("Unnamed: 0", F.lit(1)), str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p")).columns == ["id", "v", "n"]
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert readers.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}


def test_stream(spark, tmp_path):
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", src / "events.parquet")
    stream = events.windowed_counts(events.read_events(spark, str(src)))
    events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.windowed_counts(spark.read.schema(events.EVENTS).parquet(str(src / "events.parquet")))
    # The last windows stay open until the watermark passes them.
    assert got.count() > 0 and got.select("start", "event_type", "n").subtract(batch.select("start", "event_type", "n")).count() == 0
    assert events.sessions(spark.read.schema(events.EVENTS).parquet(str(src / "events.parquet"))).agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
