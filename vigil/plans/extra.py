"""Queries on selection, reshaping, calendars, models and reports that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import calendar as cal
from vigil.functions import geo
from vigil.functions import scalars as sc
from vigil.functions.scalars import quantise as q
from vigil.operators import features, quality, rates, series, spatial
from vigil.plans.core import _LINKS, _PAIR, _RATE, _WEEKLY, _links, _pair, _rated, _weekly
from vigil.plans.frames import EPI_CASES, EXPOSURES, cases, exposures, lat, lat_sql, lon, lon_sql, q_sql, table
from vigil.plans.registry import query
from vigil.plans.tables import _POINTS, _SITES, _points, _sites, hav_sql

# --- selection and cleaning -----------------------------------------------------------------------


@query("prj_existing", "SELECT s_suppkey, s_name FROM supplier")
def prj_existing(spark, d):
    """The wanted columns that there are."""
    return quality.keep_existing(table(spark, d, "supplier"), ["s_suppkey", "no_such_column", "s_name"])


@query("prj_renamed_values", "SELECT n_nationkey, regexp_replace(regexp_replace(n_name, 'NATION', 'AREA', 'g'), '_0*', '-', 'g') AS name FROM nation")
def prj_renamed_values(spark, d):
    return table(spark, d, "nation").select("n_nationkey", sc.replace_names(F.col("n_name"), {"NATION": "AREA", "_0*": "-"}).alias("name"))


@query("clean_checked_patch", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 77 ELSE n_regionkey END AS n_regionkey FROM nation")
def clean_checked_patch(spark, d):
    """A patch that fails where no row matches."""
    n = table(spark, d, "nation")
    patches = n.where("n_nationkey = 3").select("n_nationkey", F.lit(77).alias("new_value"))
    return quality.checked_patch(n, patches, ["n_nationkey"], "n_regionkey").select("n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("clean_self_lookup", f"SELECT site, {q_sql('CASE WHEN site = 5 THEN (SELECT lat + 0.0002 FROM (' + _SITES + ') WHERE site = 9) ELSE lat END')} AS lat, {q_sql('CASE WHEN site = 5 THEN (SELECT lon - 0.0002 FROM (' + _SITES + ') WHERE site = 9) ELSE lon END')} AS lon FROM ({_SITES})")
def clean_self_lookup(spark, d):
    """Site 5 takes the place of site 9, moved a little."""
    s = _sites(spark, d)
    other = s.where("site = 9").groupBy().agg(F.first("lat").alias("olat"), F.first("lon").alias("olon"))  # one row
    j, mine = s.crossJoin(F.broadcast(other)), F.col("site") == 5
    return j.select("site", q(F.when(mine, F.col("olat") + 0.0002).otherwise(F.col("lat"))).alias("lat"), q(F.when(mine, F.col("olon") - 0.0002).otherwise(F.col("lon"))).alias("lon"))


@query("flt_valid_samples", f"SELECT DISTINCT trap, dt_col, e FROM (SELECT trap, dt_col, CASE WHEN k % 5 <> 0 THEN eggs END AS e FROM ({EXPOSURES})) WHERE e IS NOT NULL AND trap IS NOT NULL AND dt_col IS NOT NULL")
def flt_valid_samples(spark, d):
    e = exposures(spark, d).select("trap", "dt_col", F.when(F.col("k") % 5 != 0, F.col("eggs")).alias("e"))
    return quality.valid_samples(e, ["trap", "dt_col", "e"])


@query("flt_value", "SELECT a, b FROM (SELECT CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS a, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS b FROM supplier) WHERE a IS NULL AND NOT (a IS NULL AND b IS NULL)")
def flt_value(spark, d):
    """Rows with a null in a column, but for those without any value."""
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("a"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey")).alias("b"))
    return quality.rows_with_value(s, "a", None)


@query("flt_null_rows", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS c FROM orders) WHERE c IS NULL")
def flt_null_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")).alias("c"))
    return quality.rows_with_null(o, "c").select("o_orderkey")


@query("flt_text", "SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7' AND s_name LIKE 'S%' AND s_name ILIKE '%PLI%'")
def flt_text(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").where(n.endswith("7") & n.startswith("S") & n.ilike("%PLI%")).select("s_suppkey")


@query("set_union", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def set_union(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_partkey").union(table(spark, d, "part").where("p_size > 40").select("p_partkey")).distinct()


# --- reshaping ------------------------------------------------------------------------------------


@query("rsh_pivot_unique", f"SELECT sector, count(*) FILTER (epidemic_year = '1996_97') AS \"1996_97\", count(*) FILTER (epidemic_year = '1997_98') AS \"1997_98\" FROM ({EPI_CASES}) WHERE epidemic_year IN ('1996_97', '1997_98') GROUP BY sector")
def rsh_pivot_unique(spark, d):
    years = ["1996_97", "1997_98"]
    n = cases(spark, d).where(F.col("epidemic_year").isin(*years)).groupBy("sector", "epidemic_year").agg(F.count("*").alias("n"))
    return quality.pivot_unique(n, ["sector"], "epidemic_year", years, "n").na.fill(0, years)


@query("rsh_prefix_scale", f"SELECT s_suppkey, {q_sql('lag0 / m')} AS lag0, {q_sql('lag1 / m')} AS lag1, day0 FROM (SELECT *, max(greatest(abs(lag0), abs(lag1))) OVER () AS m FROM (SELECT s_suppkey, s_acctbal AS lag0, s_acctbal * 0.5 AS lag1, s_nationkey AS day0 FROM supplier))")
def rsh_prefix_scale(spark, d):
    """Columns whose names begin alike are scaled together."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lag0"), (F.col("s_acctbal") * 0.5).alias("lag1"), F.col("s_nationkey").alias("day0"))
    out = features.max_abs_scale(s, quality.columns_like(s, "lag"), F.lit(True))
    return out.select("s_suppkey", q(F.col("lag0")).alias("lag0"), q(F.col("lag1")).alias("lag1"), "day0")


@query("rsh_stack", "SELECT s_suppkey, 2 AS n, s_nationkey::DOUBLE AS first_day, (s_nationkey + 1)::DOUBLE AS second_day FROM supplier")
def rsh_stack(spark, d):
    """Numbered columns of several kinds as one array of arrays."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lag0"), F.col("s_acctbal").alias("lag1"), F.col("s_nationkey").alias("day0"), (F.col("s_nationkey") + 1).alias("day1"))
    c = features.stack(s, ["lag", "day"])
    return c.select("s_suppkey", F.size("cube").alias("n"), F.col("cube")[0][1].alias("first_day"), F.col("cube")[1][1].alias("second_day"))


@query("agg_list_measures", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def agg_list_measures(spark, d):
    """The distinct values as a list (a fixed set of priorities), with extremes and their number."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return g.select("o_custkey", F.array_join("l", ",").alias("priorities"), "low", "high", F.size("l").cast("bigint").alias("n"))


@query("pop_provenance", f"SELECT target, count(*) AS n_sources, string_agg(source::VARCHAR, ',' ORDER BY source) AS sources FROM ({_LINKS}) WHERE population IS NOT NULL GROUP BY target HAVING sum(population * fraction) > 0")
def pop_provenance(spark, d):
    p = rates.provenance(_links(spark, d))
    return p.select("target", "n_sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


# --- text, calendar and scalar functions -----------------------------------------------------------


@query("fn_ids", "SELECT s_suppkey, s_suppkey::VARCHAR AS id, s_suppkey::VARCHAR AS whole, s_suppkey AS back FROM supplier")
def fn_ids(spark, d):
    """Ids that were read as floats, as text; a prefix put on and taken off."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", sc.id_text(F.concat(k.cast("string"), F.lit(".0"))).alias("id"), sc.whole_id_text(F.concat(k.cast("string"), F.lit(".0"))).alias("whole"), sc.unprefixed_id(sc.prefixed_id(k)).alias("back"))


@query("fn_labels", "SELECT sector_id, biweek, 'Sector ' || sector_id || ' | ' || biweek || ' | ' || case_count || ' cases' AS label FROM (" + _RATE + ") WHERE case_count > 2")
def fn_labels(spark, d):
    r = _rated(spark, d).where("case_count > 2")
    return r.select("sector_id", "biweek", F.format_string("Sector %s | %s | %d cases", F.col("sector_id").cast("string"), F.col("biweek"), F.col("case_count")).alias("label"))


@query("fn_finite", f"SELECT s_suppkey, {q_sql('CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal / (s_suppkey % 4) END')} AS v FROM supplier")
def fn_finite(spark, d):
    """Ratios, 0 where they are null or not finite."""
    num = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", q(sc.finite_or_zero(num, (F.col("s_suppkey") % 4).cast("double"))).alias("v"))


@query("fn_pairs", f"SELECT id, {q_sql('lat')} AS a, {q_sql('lon')} AS b FROM ({_POINTS})")
def fn_pairs(spark, d):
    """Two numbers in one text, taken apart."""
    a, b = sc.split_pair(F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string")))
    return _points(spark, d).select("id", q(a).alias("a"), q(b).alias("b"))


@query("cal_week_days", "SELECT CAST(d AS DATE) AS day, CAST(floor((CAST(d AS DATE) - DATE '1996-05-26') / 7) + 1 AS INTEGER) AS week FROM generate_series(DATE '1996-05-26', DATE '1997-05-31', INTERVAL 1 DAY) t(d)")
def cal_week_days(spark, d):
    """All days of the weeks of an epidemic year."""
    return cal.week_days(spark, 1996).select("day", "week")


@query("cal_times", "SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS text, CAST('2024-03-05' AS TIMESTAMP) + to_minutes(CAST(60 * (event_id % 24) + 30 AS INTEGER)) AS one, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST('2024-03-05' AS TIMESTAMP) + to_hours(CAST(event_id % 24 AS INTEGER)) END AS two FROM events")
def cal_times(spark, d):
    """Milliseconds as text, and days with hours in two layouts."""
    h = F.col("event_id") % 24
    plain = (h * 100 + 30).cast("string")
    other = F.when(F.col("event_id") % 9 == 0, "noon").otherwise(F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00 UTC")))
    return table(spark, d, "events").select("event_id", cal.epoch_millis_text((F.col("event_id") + 1700000000) * 1000).alias("text"), cal.day_and_hour(F.lit("2024-03-05"), plain).alias("one"), cal.day_and_hour(F.lit("2024/03/05"), other).alias("two"))


# --- quality --------------------------------------------------------------------------------------


@query("dq_types", "SELECT * FROM (SELECT 'p_size' AS \"column\", 'whole' AS kind, count(*) AS n FROM part UNION ALL SELECT 'p_retailprice', 'number', count(*) FILTER (p_partkey % 6 <> 0) FROM part UNION ALL SELECT 'p_retailprice', 'null', count(*) FILTER (p_partkey % 6 = 0) FROM part UNION ALL SELECT 'p_name', 'text', count(*) FROM part) WHERE n > 0")
def dq_types(spark, d):
    p = table(spark, d, "part").select("p_size", F.when(F.col("p_partkey") % 6 != 0, F.format_string("%.2f", "p_retailprice")).alias("p_retailprice"), F.concat(F.lit("part "), "p_name").alias("p_name"))
    return quality.type_census(p)


@query("dq_values", "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2")
def dq_values(spark, d):
    return quality.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"])


@query("dq_constant", "SELECT p_partkey, p_size FROM part")
def dq_constant(spark, d):
    """Columns with a single value go."""
    return quality.drop_constant(table(spark, d, "part").select("p_partkey", "p_size", F.lit("x").alias("one"), F.lit(None).cast("int").alias("none")))


# --- series ---------------------------------------------------------------------------------------


@query("ser_rolling_forecast", f"WITH RECURSIVE s AS (SELECT epidemic_date, n::DOUBLE AS y, row_number() OVER (ORDER BY epidemic_date) AS i FROM ({_WEEKLY})), f(i, level) AS (SELECT i, y FROM s WHERE i = 1 UNION ALL SELECT s.i, 0.3::DOUBLE * s.y + 0.7::DOUBLE * f.level FROM f JOIN s ON s.i = f.i + 1) SELECT s.epidemic_date, s.y, {q_sql('f.level')} AS forecast FROM s LEFT JOIN f ON f.i = s.i - 1")
def ser_rolling_forecast(spark, d):
    s = _weekly(spark, d).select("epidemic_date", F.col("n").cast("double").alias("y"))
    return series.rolling_forecast(s, "y", 0.3, "epidemic_date").withColumn("forecast", q(F.col("forecast")))


@query("ser_shifted", f"SELECT label, x, {q_sql('y', 3)} AS y FROM (SELECT label, x, lag(y, 4) OVER (ORDER BY label) AS y FROM ({_PAIR})) WHERE x IS NOT NULL AND y IS NOT NULL")
def ser_shifted(spark, d):
    return series.shifted(_pair(spark, d), "x", "y", 4).withColumn("y", q(F.col("y"), 3))


_W = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS p FROM ({_PAIR})), e AS (SELECT least(max(p) FILTER (x IS NOT NULL), max(p) FILTER (y IS NOT NULL)) AS last FROM p),
  k AS (SELECT p.* FROM p, e WHERE p < last AND p >= last - least(52, last)), l AS (SELECT unnest(generate_series(-8, 8)) AS lag)
  SELECT CAST(lag AS INTEGER) AS lag, covar_pop(x, y) FILTER (x IS NOT NULL AND y IS NOT NULL) / nullif(stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL), 0) AS corr, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n
  FROM (SELECT lag, a.x, b.y FROM k b CROSS JOIN l JOIN k a ON a.p = b.p + lag) GROUP BY lag"""


@query("ser_window_xcorr", f"SELECT lag, {q_sql('corr')} AS corr, n FROM ({_W})")
def ser_window_xcorr(spark, d):
    """Lagged correlation over the last 52 weeks."""
    return series.lagged_correlation(_pair(spark, d), "x", "y", 8, window=52).withColumn("corr", q(F.col("corr")))


_FLAG_LIST = "(SELECT unnest(['F', 'O', 'P']) AS flag)"


@query("ser_biweekly_dense", f"SELECT biweek, flag, count(case_id) AS n FROM (SELECT DISTINCT biweek FROM ({EPI_CASES})) CROSS JOIN {_FLAG_LIST} LEFT JOIN (SELECT biweek, flag, case_id FROM ({EPI_CASES})) USING (biweek, flag) GROUP BY ALL")
def ser_biweekly_dense(spark, d):
    """Cases of every biweek and kind, 0 where there is none."""
    n = cases(spark, d).groupBy("biweek", "flag").agg(F.count("*").alias("n"))
    spine = n.select("biweek").distinct().withColumn("flag", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))))
    return spine.join(n, ["biweek", "flag"], "left").na.fill(0, ["n"])


@query("ser_trap_biweeks", f"WITH e AS (SELECT trap, biweek, sum(eggs) AS eggs FROM ({EXPOSURES.replace('SELECT trap, dt_instal, dt_col, k,', 'SELECT trap, dt_instal, dt_col AS dt, k,', 1)}) JOIN (SELECT DISTINCT dt AS day, biweek FROM (SELECT * FROM ({EPI_CASES}))) ON day = dt GROUP BY ALL), t AS (SELECT DISTINCT trap FROM e), b AS (SELECT DISTINCT biweek FROM e) SELECT trap, biweek, eggs FROM t CROSS JOIN b LEFT JOIN e USING (trap, biweek)")
def ser_trap_biweeks(spark, d):
    """Eggs of every trap in every biweek, null where it has no sample (days without a case are left out)."""
    days = cases(spark, d).select(F.col("dt").alias("dt_col"), "biweek").distinct()
    e = exposures(spark, d).join(days, "dt_col").groupBy("trap", "biweek").agg(F.sum("eggs").alias("eggs"))
    spine = e.select("trap").distinct().crossJoin(F.broadcast(e.select("biweek").distinct()))  # biweeks: 27 a year
    return spine.join(e, ["trap", "biweek"], "left")


# --- places ---------------------------------------------------------------------------------------


_STATIONS = f"SELECT site, lat, lon FROM ({_SITES}) WHERE site <= 12"


@query("geo_station_weights", f"SELECT id, site, {q_sql('w / sum(w) OVER (PARTITION BY id)', 9)} AS weight FROM (SELECT p.id, s.site, CASE WHEN {hav_sql('p.lat', 'p.lon', 's.lat', 's.lon')} = 0 THEN 1e6 ELSE 1 / {hav_sql('p.lat', 'p.lon', 's.lat', 's.lon')} END AS w FROM ({_POINTS}) p CROSS JOIN ({_STATIONS}) s)")
def geo_station_weights(spark, d):
    """Each weather station's share in each point; the stations are the dozen with the smallest keys."""
    return _weights(spark, d).select("id", "site", q(F.col("weight"), 9).alias("weight"))


def _weights(spark, d):
    stations = _sites(spark, d).where("site <= 12").select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    w = _points(spark, d).crossJoin(F.broadcast(stations)).withColumn("w", F.when(km == 0, 1e6).otherwise(F.try_divide(F.lit(1.0), km)))  # a fixed list of stations
    return w.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("id")))


@query("geo_block_values", f"SELECT b, {q_sql('avg(v)', 4)} AS mean, count(*) AS n FROM (SELECT CAST(floor(n_nationkey / 5.0) AS BIGINT) AS b, s_acctbal AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY b")
def geo_block_values(spark, d):
    """Mean of the values of each block of five neighbouring areas."""
    j = table(spark, d, "supplier").select(F.floor(F.col("s_nationkey") / 5).alias("b"), F.col("s_acctbal").alias("v"))
    return j.groupBy("b").agg(q(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))


_HEX = "(strpos('0123456789abcdef', substr(md5(c_custkey::VARCHAR), {k}, 1)) - 1)"


@query("geo_jitter", f"SELECT c_custkey, {q_sql('x + CASE WHEN n > 1 THEN (' + _HEX.format(k=1) + ' - 7.5) * 0.001 ELSE 0 END')} AS x, {q_sql('y + CASE WHEN n > 1 THEN (' + _HEX.format(k=2) + ' - 7.5) * 0.001 ELSE 0 END')} AS y FROM (SELECT *, count(*) OVER (PARTITION BY x, y) AS n FROM (SELECT c_custkey, c_custkey * 37 % 26 AS x, c_custkey * 53 % 19 AS y FROM customer))")
def geo_jitter(spark, d):
    """Points at a place that others share are moved a little, by a hash of their key."""
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 26).alias("x"), (F.col("c_custkey") * 53 % 19).alias("y"))
    shared = p.groupBy("x", "y").agg(F.count("*").alias("n"))
    step = lambda k: (F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), k, 1), 16, 10).cast("double") - 7.5) * 0.001
    move = lambda c, k: q(F.col(c) + F.when(F.col("n") > 1, step(k)).otherwise(0.0)).alias(c)
    return p.join(shared, ["x", "y"]).select("c_custkey", move("x", 1), move("y", 2))


@query("geo_centre", f"SELECT {q_sql('avg(lat)')} AS lat, {q_sql('avg(lon)')} AS lon FROM ({_POINTS})")
def geo_centre(spark, d):
    return _points(spark, d).agg(q(F.avg("lat")).alias("lat"), q(F.avg("lon")).alias("lon"))


@query("geo_greedy_order")
def geo_greedy_order(spark, d):
    """Sites in the order of always going on to the nearest, by walking their places. A test checks it."""
    return spatial.greedy_places(_sites(spark, d))


@query("geo_overlay_concave", "SELECT 'c' AS a, n_nationkey AS b, CAST(8.0 AS DOUBLE) AS area FROM nation WHERE n_nationkey = 0")
def geo_overlay_concave(spark, d):
    """A concave area with a hole over a rectangle: 16 less the notch of 6 and the hole of 2, all within."""
    def ring(*points):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])

    n = table(spark, d, "nation").where("n_nationkey = 0")
    shape = F.array(F.array(ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (4, 3), (4, 4), (0, 4), (0, 0)), ring((1, 3.2), (3.5, 3.2), (3.5, 4.0), (1, 4.0), (1, 3.2))))
    left, right = n.select(F.lit("c").alias("area"), shape.alias("parts")), n.select(F.col("n_nationkey").alias("area"), ring((-1, -1), (9, -1), (9, 9), (-1, 9), (-1, -1)).alias("ring"))
    return spatial.overlay(left, right).select("a", "b", q(F.col("area")).alias("area"))


# --- models ---------------------------------------------------------------------------------------


def _md5_sql(expr: str) -> str:
    return f"substr(md5('split/' || {expr}), 1, 2) < '33'"


@query("ml_year_split", f"SELECT CASE WHEN epidemic_year IN ('1998_99', '1999_00') THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM ({EPI_CASES}) GROUP BY 1")
def ml_year_split(spark, d):
    return features.year_split(cases(spark, d), "epidemic_year", ["1998_99", "1999_00"]).groupBy("split").agg(F.count("*").alias("n"))


@query("ml_month_split", f"SELECT CASE WHEN {_md5_sql(chr(115) + 'trftime(dt, ' + repr('%Y-%m') + ')')} THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM ({EPI_CASES}) GROUP BY 1")
def ml_month_split(spark, d):
    return features.month_split(cases(spark, d), "dt", 20).groupBy("split").agg(F.count("*").alias("n"))


@query("ml_stratified_split", "WITH h AS (SELECT o_orderstatus AS s, ('0x' || substr(md5('split/' || o_orderkey), 1, 8))::BIGINT::DOUBLE AS h FROM orders), c AS (SELECT s, quantile_cont(h, 0.2) AS c FROM h GROUP BY s) SELECT s AS o_orderstatus, CASE WHEN h < c THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM h JOIN c USING (s) GROUP BY ALL")
def ml_stratified_split(spark, d):
    return features.stratified_split(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", 20).groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"))


@query("ml_accuracy", f"SELECT l_returnflag, count(*) AS n, {q_sql('avg(CASE WHEN (l_quantity > 25) = (l_extendedprice > 900) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM lineitem GROUP BY 1")
def ml_accuracy(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("truth"), (F.col("l_extendedprice") > 900).alias("guess"))
    return features.classification_metrics(li, "truth", "guess", "l_returnflag").withColumn("accuracy", q(F.col("accuracy")))


@query("ml_svm")
def ml_svm(spark, d):
    """A linear support vector machine on the lags of the weekly series; a test checks that it separates."""
    return features.svm_model(_lagged(spark, d), ["naive", "older"], "high").transform(_lagged(spark, d)).select("epidemic_date", "high", "prediction")


@query("ml_boosted")
def ml_boosted(spark, d):
    n = _lagged(spark, d)
    return features.tree_model(n, ["naive", "older"], "y", boosted=True).transform(n).select("epidemic_date", "y", "prediction")


def _lagged(spark, d):
    w, y = Window.orderBy("epidemic_date"), F.col("n").cast("double")
    s = _weekly(spark, d).select("epidemic_date", y.alias("y"), F.lag(y, 1).over(w).alias("naive"), F.lag(y, 2).over(w).alias("older")).dropna()
    mean = s.agg(F.avg("y").alias("m"))
    return s.crossJoin(F.broadcast(mean)).withColumn("high", (F.col("y") > F.col("m")).cast("double")).drop("m")


@query("ml_runs", "SELECT run, tag, CAST(version AS INTEGER) AS version FROM (SELECT event_id AS run, event_type AS tag, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS version FROM events) WHERE tag = 'click' AND k = '7'")
def ml_runs(spark, d):
    """Runs of a registry with a tag and a parameter, with their versions."""
    e = table(spark, d, "events").select(F.col("event_id").alias("run"), F.col("event_type").alias("tag"), F.create_map(F.lit("k"), F.from_json("props", "k string")["k"]).alias("params"))
    return features.registered_runs(e, "click", k=7).select("run", "tag", "version")


@query("feat_coordinates", f"SELECT site, {q_sql('(lat - avg(lat) OVER ()) / stddev_pop(lat) OVER ()')} AS z_lat, {q_sql('(lon - avg(lon) OVER ()) / stddev_pop(lon) OVER ()')} AS z_lon FROM ({_SITES})")
def feat_coordinates(spark, d):
    z = features.scaled_coordinates(_sites(spark, d), "lat", "lon")
    return z.select("site", q(F.col("z_lat")).alias("z_lat"), q(F.col("z_lon")).alias("z_lon"))


# --- reports --------------------------------------------------------------------------------------


@query("dash_grid_years", f"WITH n AS (SELECT id, min(struct_pack(d := {hav_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')}, site := site)).site AS site FROM ({_POINTS}) p CROSS JOIN ({_SITES}) g GROUP BY id) SELECT site, epidemic_year, count(*) AS n FROM ({EPI_CASES}) c JOIN n ON n.id = c.place GROUP BY ALL")
def dash_grid_years(spark, d):
    """Cases of every grid point and year."""
    n = spatial.nearest(_points(spark, d), _sites(spark, d)).select(F.col("id").alias("place"), "site")
    return cases(spark, d).select("place", "epidemic_year").join(n, "place").groupBy("site", "epidemic_year").agg(F.count("*").alias("n"))


_TWO = f"SELECT sector, count(*) FILTER (epidemic_year = '1996_97') AS a, count(*) FILTER (epidemic_year = '1998_99') AS b FROM ({EPI_CASES}) GROUP BY sector"


@query("dash_two_years", f"SELECT 'plain' AS scale, {q_sql('covar_pop(a, b) / nullif(var_pop(a), 0)')} AS slope, count(*) AS n FROM ({_TWO}) UNION ALL SELECT 'log', {q_sql('covar_pop(ln(a), ln(b)) / nullif(var_pop(ln(a)), 0)')}, count(*) FROM (SELECT * FROM ({_TWO}) WHERE a > 0 AND b > 0)")
def dash_two_years(spark, d):
    """The line between two years' counts; with logarithms, areas without a case in either year are left out."""
    g = cases(spark, d).groupBy("sector").agg(F.count_if(F.col("epidemic_year") == "1996_97").alias("a"), F.count_if(F.col("epidemic_year") == "1998_99").alias("b"))
    both = g.select(F.lit("plain").alias("scale"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).unionByName(g.where("a > 0 and b > 0").select(F.lit("log").alias("scale"), F.ln("a").alias("a"), F.ln("b").alias("b")))
    return features.linear_fit(both, "a", "b", "scale").select("scale", q(F.col("slope")).alias("slope"), "n")


@query("dash_toggle", f"SELECT key, count(*) % 2 = 1 AS chosen FROM (SELECT printf('%.6f', lat) || ',' || printf('%.6f', lon) AS key FROM ({_POINTS}) WHERE id % 3 < 2) GROUP BY key")
def dash_toggle(spark, d):
    """Places chosen and unchosen by clicks: a place, to six digits, is chosen after an odd number."""
    key = F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"))
    return _points(spark, d).where("id % 3 < 2").groupBy(key.alias("key")).agg((F.count("*") % 2 == 1).alias("chosen"))


@query("dash_sector_series", f"WITH t AS (SELECT sector_id, sum(case_count) AS total FROM ({_RATE}) GROUP BY 1), c AS (SELECT sector_id FROM t ORDER BY total DESC, sector_id LIMIT 1) SELECT sector_id, biweek, case_count, total::BIGINT AS total FROM ({_RATE}) JOIN c USING (sector_id) JOIN t USING (sector_id)")
def dash_sector_series(spark, d):
    """The metric of the sector chosen on the map (the one with the most cases) and its series."""
    r = _rated(spark, d)
    totals = r.groupBy("sector_id").agg(F.sum("case_count").alias("total"))
    chosen = totals.orderBy(F.desc("total"), "sector_id").limit(1)
    return r.join(F.broadcast(chosen), "sector_id").select("sector_id", "biweek", "case_count", "total")


@query("dash_offset_years", f"SELECT epidemic_year, CAST(week + 52 * (CAST(left(epidemic_year, 4) AS INTEGER) - (SELECT min(CAST(left(epidemic_year, 4) AS INTEGER)) FROM ({EPI_CASES}))) AS INTEGER) AS at, count(*) AS n FROM ({EPI_CASES}) GROUP BY ALL")
def dash_offset_years(spark, d):
    """Weekly counts of each year, one year after the other on a common axis."""
    c = cases(spark, d).groupBy("epidemic_year", "week").agg(F.count("*").alias("n")).withColumn("y", F.substring("epidemic_year", 1, 4).cast("int"))
    first = c.agg(F.min("y").alias("y0"))
    return c.crossJoin(F.broadcast(first)).select("epidemic_year", (F.col("week") + 52 * (F.col("y") - F.col("y0"))).cast("int").alias("at"), "n")
