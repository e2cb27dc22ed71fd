"""Queries over whole tables: no site, trap, date or point is left out."""

from pyspark.sql import functions as F

from vigil.plans import frames, load, registry, tables

load()
SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF)


def test_all_sites(spark):
    every = {r[0] for r in frames.table(spark, SF, "supplier").select("s_suppkey").collect()}
    assert {r.site for r in run(spark, "geo_dbscan").collect()} == every
    for name in ("geo_haversine", "geo_planar", "geo_geodesic"):
        rows = run(spark, name).collect()
        assert {r.site for r in rows} == every and len(rows) == frames.table(spark, SF, "customer").count()


def test_all_periods(spark):
    from vigil.functions.calendar import biweek_label

    every = {r[0] for r in frames.exposures(spark, SF).select(biweek_label(F.col("dt_col"))).distinct().collect()}
    got = run(spark, "geo_idw").select("period", "traps").collect()
    assert {r.period for r in got} == every
    traps = {r[0] for r in frames.exposures(spark, SF).select("trap").distinct().collect()}
    assert {int(t) for r in got for t in r.traps.split(",")} == traps


def test_feat_matrix_all(spark):
    from vigil.functions.calendar import epidemic_week, epidemic_year

    day = F.col("dt_col")
    e = frames.exposures(spark, SF).groupBy("trap", (epidemic_year(day) * 53 + epidemic_week(day)).alias("week")).agg(F.sum("eggs").alias("value"), F.max("dt_col").alias("day"))
    value = {(r.trap, r.week): (r.value, r.day) for r in e.collect()}
    weeks = sorted({w for _, w in value})
    place = {r.site: (r.lat, r.lon) for r in tables._sites(spark, SF).collect()}

    def km(a, b):
        from math import asin, cos, radians, sin, sqrt

        (p, q), (u, v) = place[a], place[b]
        return 12742 * asin(sqrt(sin(radians(u - p) / 2) ** 2 + cos(radians(p)) * cos(radians(u)) * sin(radians(v - q) / 2) ** 2))

    near = {t: sorted(place, key=lambda o: (-1 if o == t else round(km(t, o), 9), o))[:6] for t in place}
    want = {}
    for (trap, week), (v, day) in value.items():
        k = weeks.index(week)
        before = {o: [w for w in weeks[max(0, k - 6) : k][::-1] if (o, w) in value] for o in near[trap]}
        fit = [o for o in near[trap] if len(before[o]) >= 3][:2]
        if len(fit) == 2:
            want[trap, week] = (v, *fit, ",".join(str(value[fit[1], w][0]) for w in before[fit[1]][:3]), ",".join(str((day - value[fit[0], w][1]).days) for w in before[fit[0]][:3]))
    got = {(r.trap, r.week): (r.value, r.trap0, r.trap1, r.values1, r.days0) for r in run(spark, "feat_matrix").collect()}
    assert {t for t, _ in got} == set(place) and got == want


def test_nearest_vector_all(spark):
    rows = frames.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    got = {r.id: r.nearest for r in run(spark, "geo_nearest_vector").collect()}
    assert set(got) == {r.vec_id for r in rows if r.vec_id % 20 == 0}
    for r in rows:
        if r.vec_id in got:
            far = {o.vec_id: sum((a - b) ** 2 for a, b in zip(r.embedding, o.embedding)) for o in rows if o.vec_id != r.vec_id}
            assert far[got[r.vec_id]] <= min(far.values()) + 1e-6


def test_no_id_bounds(spark):
    sites = frames.table(spark, SF, "supplier").count()
    assert run(spark, "dash_used_traps").count() == 2 * sites
    points = frames.table(spark, SF, "customer").select("c_custkey")
    assert {r.id for r in run(spark, "geo_station_idw").collect()} == {r[0] for r in points.collect()}
    want = {r[0] for r in frames.exposures(spark, SF).select("trap").distinct().collect()}
    assert {r.trap for r in run(spark, "iv_trailing_window").select("trap").distinct().collect()} == want


def test_ids_past_the_bounds(spark, tmp_path):
    """More suppliers and points than the bounds let in."""
    for name in ("supplier", "customer"):
        frames.table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    key = {"supplier": "s_suppkey", "customer": "c_custkey"}
    for name, k in key.items():
        frames.table(spark, SF, name).withColumn(k, F.col(k) + 1000).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    n = frames.table(spark, d, "supplier").count()
    assert registry.queries()["dash_used_traps"](spark, d).count() == 2 * n
    ids = {r.id for r in registry.queries()["geo_station_idw"](spark, d).collect()}
    assert max(ids) >= 1000 and len(ids) == frames.table(spark, d, "customer").count()
