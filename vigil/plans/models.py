"""Queries on shapefiles, statistics of dependence and models whose fit is a sum over rows."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import geo
from vigil.functions.scalars import quantise as q
from vigil.operators import dependence, intervals, learning, spatial, statespace
from vigil.operators.shared import shared_dir
from vigil.plans.core import _WEEKLY, _weekly
from vigil.plans.extra import _sites
from vigil.plans.tables import _POINTS, _points
from vigil.plans.frames import AREAS, EXPOSURES, areas, exposed_lines, q_sql, table
from vigil.plans.registry import query
from vigil.sources import shapefile


def _frames(spark, d):
    """Each area with a hole in its middle half, and a second part south of all."""
    corner = lambda x, y, w, h: F.array(*[F.struct((F.col("x0") + x + i * w).alias("x"), (F.col("y0") + y + j * h).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    part = F.array(corner(0.0, 0.0, 0.038, 0.052), corner(0.0095, 0.013, 0.019, 0.026))
    return areas(spark, d).select("area", F.concat(F.lit("area "), F.col("area").cast("string")).alias("name"), F.array(part, F.array(corner(0.0, -2.0, 0.019, 0.026))).alias("parts"))


@query("src_shapefile", f"SELECT area, 'area ' || area AS name, 2::BIGINT AS n_parts, 1::BIGINT AS n_holes, {q_sql('0.038 * 0.052 / 1e-6', 3)} AS size, {q_sql('x0 + (0.019 * 0.75 + 0.0095 * 0.25)')} AS cx, {q_sql('y0 + (0.026 * 0.75 + (0.013 - 2.0) * 0.25)')} AS cy FROM ({AREAS})")
def src_shapefile(spark, d):
    """Areas written as shapefiles and read again: parts, holes, size and centre of each."""
    folder = f"{shared_dir(spark)}/vigil-shapes-{spark.sparkContext.applicationId}"
    shapefile.write_shapefile(_frames(spark, d), folder)
    s = shapefile.read_shapefile(spark, folder, records=8)
    x0, y0 = F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))["x"], F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))["y"]
    near = F.transform("parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] - x0).alias("x"), (v["y"] - y0).alias("y")))))
    cx, cy = geo.parts_centroid(near)
    holes = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p) - 1)
    return s.select("area", "name", F.size("parts").cast("long").alias("n_parts"), holes.cast("long").alias("n_holes"), q(geo.parts_area(near) / 1e-6, 3).alias("size"), q(x0 + cx).alias("cx"), q(y0 + cy).alias("cy"))


@query("geo_sector_centres")
def geo_sector_centres(spark, d):
    """Centres of areas with parts and holes, taken in metres of the zone and given in degrees; a test holds them against plain sums."""
    x, y = geo.parts_centroid(geo.projected(F.col("parts")))
    s = _frames(spark, d).select("area", x.alias("x"), y.alias("y"), geo.parts_area(geo.projected(F.col("parts"))).alias("m2"))
    lat, lon = geo.utm_to_degrees(F.col("x"), F.col("y"))
    return s.select("area", q(lat).alias("lat"), q(lon).alias("lon"), q(F.col("m2"), 0).alias("m2"))


@query("geo_utm_unknown", f"SELECT id, {q_sql('CASE WHEN id % 7 <> 0 THEN lat END')} AS lat, {q_sql('CASE WHEN id % 5 <> 0 THEN lon END')} AS lon FROM ({_POINTS})")
def geo_utm_unknown(spark, d):
    """Points in metres, some with a coordinate of 0 for an unknown one, in degrees."""
    x, y = geo.degrees_to_utm(F.col("lat"), F.col("lon"))
    p = _points(spark, d)
    known = lambda c, k, v: F.when(F.col("id") % k != 0, v).when(F.col("id") % k == 0, 0.0).alias(c)
    p = p.select("id", x.alias("tx"), y.alias("ty"), known("x", 7, x), known("y", 5, y))
    lat = geo.zone_to_degrees(F.col("x"), F.col("ty"))[0]
    lon = geo.zone_to_degrees(F.col("tx"), F.col("y"))[1]
    return p.select("id", q(lat).alias("lat"), q(lon).alias("lon"))


@query("iv_daily_dense", f"""WITH s AS (SELECT trap, CAST(day AS DATE) AS day, sum(v) AS eggs FROM (SELECT trap, eggs / (dt_col - dt_instal) AS v, unnest(generate_series(dt_instal, dt_col - 1, INTERVAL 1 DAY)) AS day FROM ({EXPOSURES})) GROUP BY ALL),
  d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
  SELECT trap, day, {q_sql('eggs', 4)} AS eggs FROM (SELECT DISTINCT trap FROM s) CROSS JOIN d LEFT JOIN s USING (trap, day)""")
def iv_daily_dense(spark, d):
    """Daily values of every trap on every day; null where it was not exposed."""
    return intervals.dense_daily_spread(exposed_lines(spark, d)).select("trap", "day", q(F.col("eggs"), 4).alias("eggs"))


_LAGS = f"SELECT l.lag, n::DOUBLE AS y, lag(n, CAST(l.lag AS INTEGER)) OVER (PARTITION BY l.lag ORDER BY epidemic_date)::DOUBLE AS x FROM ({_WEEKLY}) CROSS JOIN (SELECT unnest([1, 2, 4, 52]) AS lag) l"


def _lags(spark, d):
    w = Window.orderBy("epidemic_date")
    n = F.col("n").cast("double")
    return _weekly(spark, d).select(n.alias("y"), *[F.lag(n, k).over(w).alias(f"x{k}") for k in (1, 2, 4, 52)])


@query("ser_p_values", f"""WITH c AS (SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS r FROM ({_LAGS}) WHERE x IS NOT NULL GROUP BY lag)
  SELECT lag, n, {q_sql('r')} AS r, {q_sql('''CASE WHEN n % 2 = 0
    THEN 1 - abs(r) * list_sum(list_transform(range(CAST(n // 2 - 1 AS BIGINT)), lambda k: exp(k * ln(1 - r * r) + lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4))))
    ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * list_sum(list_transform(range(CAST((n - 3) // 2 AS BIGINT)), lambda k: exp((k + 0.5) * ln(1 - r * r) + k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2))))) END''')} AS p_value FROM c""")
def ser_p_values(spark, d):
    """Correlation of the weekly cases with those 1, 2, 4 and 52 weeks before, with its p-value."""
    c = dependence.correlations(_lags(spark, d), [("y", f"x{k}") for k in (1, 2, 4, 52)])
    return c.select(F.substring("y", 2, 3).cast("int").alias("lag"), "n", q(F.col("r")).alias("r"), q(F.col("p_value")).alias("p_value"))


_PSI = "(coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0::DOUBLE / i)), 0) - 0.57721566490153286::DOUBLE)"


@query("ser_information", f"""WITH s AS (SELECT lag, x, y, row_number() OVER () AS i FROM ({_LAGS}) WHERE x IS NOT NULL AND lag < 4),
  z AS (SELECT lag, i, x / stddev_pop(x) OVER (PARTITION BY lag) AS x, y / stddev_pop(y) OVER (PARTITION BY lag) AS y FROM s),
  d AS (SELECT a.lag, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM z a JOIN z b ON a.lag = b.lag),
  r AS (SELECT *, nth_value(greatest(dx, dy), 4) OVER (PARTITION BY lag, i ORDER BY greatest(dx, dy) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r FROM d),
  c AS (SELECT lag, i, count(*) FILTER (dx < r OR (r = 0 AND dx = 0)) AS nx, count(*) FILTER (dy < r OR (r = 0 AND dy = 0)) AS ny FROM r GROUP BY lag, i),
  t AS (SELECT lag, count(*) AS n, avg({_PSI.format(n='nx')} + {_PSI.format(n='ny')}) AS m FROM c GROUP BY lag)
  SELECT CAST(lag AS INTEGER) AS lag, {q_sql(f"greatest(0, {_PSI.format(n='n')} + {_PSI.format(n='3')} - m)", 5)} AS information FROM t""")
def ser_information(spark, d):
    """Mutual information of the weekly cases and those one and two weeks before, by nearest neighbours."""
    s = _lags(spark, d)
    rows = [(k, dependence.mutual_information(s, f"x{k}", "y")) for k in (1, 2)]
    return spark.createDataFrame(rows, "lag int, information double").withColumn("information", q(F.col("information"), 5))


@query("geo_grid")
def geo_grid(spark, d):
    """Grid points half a kilometre apart over the bounds of the sites; tests check bounds, spacing and count."""
    return spatial.grid_over(_sites(spark, d), 500.0)


def _lines(spark, d):
    """Order lines: quantity, discount, tax, price in thousands, whether sent back, and a key."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"),
        (F.col("l_extendedprice").cast("double") / 1000).alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("back"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"),
    )


def _scored(df, name: str):
    """Number of rows, mean error and mean squared error of a prediction of the price."""
    off = F.col("price") - F.col("prediction")
    return df.agg(F.lit(name).alias("model"), F.count("prediction").alias("n"), q(F.avg(off), 4).alias("bias"), q(F.sqrt(F.avg(off * off)), 4).alias("rmse"))


@query("ml_additive")
def ml_additive(spark, d):
    """The price of all order lines by a smooth function of quantity and slopes of discount and tax; a test holds the fit against numpy."""
    li = _lines(spark, d)
    return _scored(learning.predict_additive(li, learning.additive_model(li, "price", ["quantity"], ["discount", "tax"], pieces=8)), "additive")


@query("ml_additive_logit")
def ml_additive_logit(spark, d):
    """The chance that a line is sent back, by a smooth surface of quantity and discount: mean prediction by flag."""
    li = _lines(spark, d)
    m = learning.additive_model(li, "back", [("quantity", "discount")], ["tax"], link="logit", pieces=4, steps=8)
    return learning.predict_additive(li, m).groupBy("back").agg(F.count("*").alias("n"), q(F.avg("prediction"), 4).alias("chance"))


@query("ml_fourier_margin")
def ml_fourier_margin(spark, d):
    """The price by an epsilon-insensitive machine on random waves."""
    li = _lines(spark, d)
    m = learning.margin_model(li, ["quantity", "discount"], "price", loss="epsilon_insensitive", gamma=0.5, features=50, penalty="elasticnet", epsilon=0.1, steps=20)
    return _scored(learning.predict_margin(li, m), "waves")


@query("ml_network")
def ml_network(spark, d):
    """The price by a network of three layers, fitted by gradients of all rows."""
    li = _lines(spark, d)
    m = learning.network(li, ["quantity", "discount", "tax"], "price", rate=0.02, steps=20)
    return _scored(learning.predict_network(li, m), "network")


@query("ml_random_layers")
def ml_random_layers(spark, d):
    """The price by random layers of 2 to 32 units, all fitted from one pass."""
    li = _lines(spark, d)
    models = learning.least_squares_sizes(li, ["quantity", "discount", "tax"], "price", [2, 8, 32])
    out = None
    for size, m in models.items():
        one = _scored(learning.predict_layer(li, m), f"layer of {size}")
        out = one if out is None else out.unionByName(one)
    return out


@query("ml_search")
def ml_search(spark, d):
    """Sampled sizes and ridges of a random layer over three folds: every fold's error."""
    li = _lines(spark, d)

    def fit(rows, p):
        return learning.least_squares_sizes(rows, ["quantity", "discount"], "price", [p["size"]], ridge=p["ridge"])[p["size"]]

    def score(m, rows):
        return -math.sqrt(learning.predict_layer(rows, m).agg(F.avg(F.pow(F.col("price") - F.col("prediction"), 2)).alias("e")).first()["e"])

    _, results = learning.random_search(li, fit, score, {"size": [2, 8, 24], "ridge": [1e-6, 1.0, 1e4]}, "key", n=3, n_folds=3)
    return results.select("candidate", F.to_json("parameters").alias("parameters"), "fold", q(F.col("score"), 4).alias("score"))


@query("ser_seasonal_forecast")
def ser_seasonal_forecast(spark, d):
    """One-step forecasts of every nation's monthly orders by a seasonal model, each nation fitted where it lies; a test checks the filter."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    months = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").cast("double").alias("orders"))
    return statespace.seasonal_forecasts(months, "nation", "month", "orders", steps=40).withColumn("forecast", q(F.col("forecast"), 3))
