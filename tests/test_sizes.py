"""Work that must not grow faster than the input, and rows that such forms could get wrong."""

import datetime
import math
import random

from pyspark.sql import functions as F

from vigil.functions import geo
from vigil.operators import intervals, spatial, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors(spark):
    """Against plain sums: copies, ties, null and short vectors, components unknown or not numbers; no row for each pair is planned."""
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(5)]) for i in range(300)] + [(300 + i, [0.5] * 5) for i in range(8)]
    rows += [(400, None), (401, [0.1, None, 0.2, 0.3, 0.4]), (402, [0.3, 0.1]), (403, [float("nan")] * 5), (404, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    single = {r.vec_id: r.embedding for r in df.collect()}

    def rank(a, b):
        terms = [(x - y) * (x - y) for x, y in zip(a or [], b or []) if x is not None and y is not None]
        d = sum(terms) if terms else None
        return (2, 0.0) if d is None else (1, 0.0) if math.isnan(d) else (0, math.floor(d * 1e6 + 0.5))

    asked = df.where("vec_id % 3 = 0 or vec_id >= 300")
    out = vectors.nearest_vectors(df, asked)
    assert "NestedLoop" not in plan(out)
    want = {i: min((*rank(x, y), j) for j, y in single.items() if j != i)[-1] for i, x in single.items() if i % 3 == 0 or i >= 300}
    assert {r.id: r.nearest for r in out.collect()} == want


def test_geodesic_is_not_written_out(spark):
    """Each value of the iteration stands once in the expression, which is evaluated term by term."""
    df = spark.range(1).select(*[F.lit(1.0).alias(c) for c in "abcd"]).select(geo.geodesic_m(*map(F.col, "abcd")).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().count("sin(") < 20


def places(spark, n=300, seed=5):
    """Sites that share few places, two of them without one."""
    rng = random.Random(seed)
    at = [(round(rng.uniform(-20.1, -20.0), 3), round(rng.uniform(-44.1, -44.0), 3)) for _ in range(25)]
    rows = [(i, *rng.choice(at), rng.choice([None, float(i)])) for i in range(n)] + [(900, None, 1.0, 1.0), (901, 1.0, None, 1.0)]
    return rows, spark.createDataFrame(rows, "site long, lat double, lon double, value double")


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_shared_places(spark, monkeypatch):
    """Edges, sums, clusters and weights of sites that share places are those of all pairs; the greedy order has no limit."""
    monkeypatch.setattr(spatial, "LISTED", 3)
    rows, df = places(spark)
    known = [r for r in rows if None not in r[1:3]]
    near = {(a[0], b[0]): km(a, b) for a in known for b in known if a[0] != b[0] and km(a, b) <= 2.0}
    edges = spatial.distance_edges(df, 2.0).collect()
    assert len(edges) == len(near) / 2 and all(abs(near[r.a, r.b] - r.km) < 1e-9 and r.a < r.b for r in edges)
    got = {r.site: (r.smoothed, r.n) for r in spatial.neighbour_sums(df, 2.0, 1000.0).collect()}
    for a in known:
        met = [(b[3], near[a[0], b[0]]) for b in known if (a[0], b[0]) in near]
        terms = [v * 1000.0**-d for v, d in met if v is not None]
        assert got[a[0]][1] == len(met) and abs(got[a[0]][0] - sum(terms) / len(terms)) < 1e-9
    assert len(got) == len(known)
    labels = {r.site: r.cluster for r in spatial.dbscan(df, 1.0, 30).collect()}
    close = {a[0]: {b[0] for b in known if km(a, b) <= 1.0} for a in known}
    core = {s for s, others in close.items() if len(others) >= 30}
    want = {s: s for s in core}
    while (new := {s: min(want[o] for o in close[s] if o in core) for s in core}) != want:
        want = new
    assert core and labels == {s[0]: want.get(s[0], min((want[o] for o in close.get(s[0], ()) if o in core), default=-1)) for s in rows}
    left, order = sorted(known)[1:], sorted(known)[:1]
    while left:
        a = order[-1]
        order.append(left.pop(min(range(len(left)), key=lambda i: ((left[i][1] - a[1]) ** 2 + (left[i][2] - a[2]) ** 2, left[i][0]))))
    assert [r.site for r in spatial.greedy_places(df).orderBy("position").collect()] == [r[0] for r in order]
    many = spark.range(6000).selectExpr("id as site", "id % 7 * 1.0 as lat", "id % 5 * 1.0 as lon")
    assert spatial.greedy_places(many).agg(F.count("*"), F.max("position")).first() == (6000, 5999)
    points = [(1, *known[0][1:3]), (1, -20.05, -44.05), (2, None, 0.0)]
    out = {(r.id, r.lat): r.value for r in spatial.weighted_by_all(spark.createDataFrame(points, "id long, lat double, lon double"), df).collect()}
    for p in points[:2]:
        w = [(1 / km(p, s), s[3]) for s in known if s[3] is not None and s[1:3] != p[1:]]
        assert abs(out[p[:2]] - sum(a * b for a, b in w) / sum(a for a, _ in w)) < 1e-9
    assert out[2, None] is None


def test_traps_at_the_place_itself(spark):
    """Of several traps at a centre the largest value counts, as in the SQL of geo_idw."""
    c = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    s = spark.createDataFrame([("p", 1, 0.0, 0.0, 5.0), ("p", 2, 0.0, 0.0, 7.0), ("p", 3, 1.0, 0.0, 9.0)], "period string, trap long, lat double, lon double, value double")
    assert [(r.idw_value, r.traps) for r in spatial.idw(c, s).collect()] == [(7.0, "1,2,3")]


def test_neighbours_of_sites(spark):
    rows, df = places(spark, 80)
    known = [r for r in rows if None not in r[1:3]]
    out = {}
    near = spatial.neighbours(df, 4)
    for r in near.collect():
        out.setdefault(r.site, []).append((r["rank"], r.other))
    for a in known:
        others = sorted((km(a, b) if a[1:3] != b[1:3] else 0.0, b[0]) for b in known if b[0] != a[0])[:4]
        assert [o for _, o in sorted(out[a[0]])] == [a[0], *[b for _, b in others]]


def test_trailing_window_and_mismatch_are_not_spread(spark):
    """Exposures aren't spread over days, and two groupings by one key are one: no join."""
    from vigil.plans import load, registry

    load()
    q = registry.queries()
    d = "/root/testdata/sf0.001"
    assert "Join" not in plan(q["jn_mismatch"](spark, d))
    assert plan(q["iv_trailing_window"](spark, d)).count("explode(sequence(date_sub") == 0


def test_daily_spread_shuffles_no_row_a_day(spark):
    """Sums a day against plain ones: long, overlapping, early, empty and null exposures; rows meet by blocks of days, the dense form by no join."""
    rng = random.Random(4)
    day = lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(n)
    rows = [(rng.choice([1, 2, 3, None]), day(a), day(a + rng.choice([-3, 0, 1, 7, 16, 70])), rng.choice([None, 1.0, 5.0, 12.0])) for a in (rng.randrange(-90, 90) for _ in range(120))]
    rows += [(9, day(5), day(5), 1.0), (8, None, day(3), 1.0), (7, day(-200), day(-199), None)]
    df = spark.createDataFrame(rows, "trap int, dt_instal date, dt_col date, eggs double").repartition(3)
    want = {}
    for trap, a, b, v in rows:
        for i in range((b - a).days if a else 0):
            want.setdefault((trap, a + datetime.timedelta(i)), []).append(None if v is None else v / (b - a).days)
    want = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
    same = lambda x, y: x is y if x is None or y is None else abs(x - y) < 1e-9
    spread = intervals.daily_spread(df)
    got = {(r.trap, r.day): r.eggs for r in spread.collect()}
    assert len(got) == spread.count() and got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    grouped = [line for line in plan(spread).splitlines() if "HashAggregate" in line or "hashpartitioning" in line]
    assert grouped and all("_block" in line and "day#" not in line for line in grouped)
    dense = intervals.dense_daily_spread(df)
    assert not [line for line in plan(dense).splitlines() if "SortMergeJoin" in line or "HashJoin" in line]
    days = sorted(k[1] for k in want)
    filled = {(r.trap, r.day): r.eggs for r in dense.collect()}
    assert dense.count() == len(filled) == len({k[0] for k in want}) * ((days[-1] - days[0]).days + 1)
    assert all(same(v, None if k[0] is None else want.get(k)) for k, v in filled.items())
    assert intervals.dense_daily_spread(df.limit(0)).count() == 0
