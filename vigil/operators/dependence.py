"""Dependence of two columns: mutual information by nearest neighbours, correlations with p-values, counts in sorted ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.special import correlation_p_value, digamma
from vigil.operators.shared import cut, drop_cut
from vigil.operators.spatial import _nearest_k, _side, _Square

#: Ranges that values are dealt to for running counts; their limits are approximate quantiles.
RANGES = 256


def counts_up_to(values: DataFrame, asked: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Rows of ``asked`` (key columns, ``at``, ``with_equal``) with ``below``: how many of ``values`` (v, n) are under ``at``, or equal where ``with_equal``.

    Values and questions are dealt to ranges of values, sorted and counted within each; a range starts with the sum of those
    before it (one row a range). Equal values should come summed up in ``n``.
    """
    limits = [x for x in dict.fromkeys(values.approxQuantile("v", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))] if ranges > 1 else []
    bucket = lambda c: F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]).cast("array<double>"), lambda x: x < c))
    v = values.select(F.col("v").alias("_p"), F.lit(1).alias("_o"), F.col("n").cast("long").alias("_n"), bucket(F.col("v")).alias("_b"))
    q = asked.withColumns({"_p": F.col("at"), "_o": F.when(F.col("with_equal"), 2).otherwise(0), "_n": F.lit(0).cast("long"), "_b": bucket(F.col("at"))})
    both = q.unionByName(v, allowMissingColumns=True)
    running = F.sum("_n").over(Window.partitionBy("_b").orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0))
    before = v.groupBy("_b").agg(F.sum("_n").alias("_t")).withColumn("_t", F.sum("_t").over(Window.orderBy("_b")) - F.col("_t"))  # a row a range
    starts = before.select(F.col("_b").alias("_c"), "_t")
    out = both.withColumn("below", running).where("_o <> 1")
    # A range without values starts like the last one before it: all values under it are in earlier ranges.
    last = F.max(F.struct("_c", "_t")).alias("_l")
    known = out.select("_b").distinct().join(F.broadcast(starts), F.col("_c") <= F.col("_b"), "left").groupBy("_b").agg(last)
    total = v.groupBy(F.col("_b").alias("_c")).agg(F.sum("_n").alias("_own"))
    known = known.join(F.broadcast(total), F.col("_l._c") == F.col("_c"), "left").select("_b", F.coalesce(F.col("_l._t") + F.when(F.col("_l._c") < F.col("_b"), F.col("_own")).otherwise(0), F.lit(0)).alias("_start"))
    return out.join(F.broadcast(known), "_b").select(*asked.columns, (F.col("below") + F.col("_start")).alias("below"))


def mutual_information(df: DataFrame, x: str, y: str, k: int = 3, ranges: int = RANGES) -> float:
    """Mutual information in nats of two numeric columns (Kraskov, Stoegbauer and Grassberger, 2004, first estimator), never under 0.

    Both are divided by their deviation. A row's radius is the distance (the larger of both differences) to its ``k``-th neighbour, found
    by cells of the plane; neighbours in each column alone, nearer than it, are differences of two running counts. Equal rows
    are counted, not repeated: of a group larger than ``k`` the radius is 0 and neighbours are those of equal value. Rows with a null
    or a value that isn't finite take no part; None for fewer than k + 1 rows or a constant column.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for c in ("x", "y"):
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    s = rows.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    if s["n"] <= k or not s["x"] or not s["y"]:
        return None
    points = cut(rows.groupBy((F.col("x") / s["x"]).alias("lat"), (F.col("y") / s["y"]).alias("lon")).agg(F.count("*").alias("n")), "points")
    sites = points.select(F.col("n").alias("m"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col("lat").alias("s0"), F.col("lon").alias("s1"), F.xxhash64("lat", "lon").alias("tie"))
    asked = points.where(F.col("n") <= k).select("lat", "lon", F.col("lat").alias("c0"), F.col("lon").alias("c1"))
    extent = points.agg(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).first()
    near = _nearest_k(asked, sites, ["lat", "lon"], [], 2, k + 1, _side(sites, 2, 1e-9) * (k + 1) ** 0.5, max(extent) * 2 + 1, _Square())
    reached = F.sum("m").over(Window.partitionBy("lat", "lon").orderBy("d", "tie").rowsBetween(Window.unboundedPreceding, 0))
    radius = near.withColumn("c", reached).where(F.col("c") > k).groupBy("lat", "lon").agg(F.min("d").alias("r"))
    balls = cut(points.join(radius, ["lat", "lon"], "left").withColumn("r", F.coalesce("r", F.lit(0.0))), "balls")
    both, zero = [], F.col("r") == 0
    for c in ("lat", "lon"):
        values = points.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n"))
        # The neighbour that sets the radius lies outside: ends are drawn in by what rounding of the sum may add.
        inner = F.col("r") - 4e-16 * (F.abs(c) + F.col("r"))
        ends = [balls.select("lat", "lon", (F.col(c) + sign * F.when(zero, 0.0).otherwise(inner)).alias("at"), (zero if sign > 0 else ~zero).alias("with_equal"), F.lit(sign).alias("sign")) for sign in (1, -1)]
        found = counts_up_to(values, ends[0].unionByName(ends[1]), ranges)
        both.append(found.groupBy("lat", "lon").agg(F.sum(F.col("sign") * F.col("below")).alias(f"n_{c}")))
    counted = balls.join(both[0], ["lat", "lon"]).join(both[1], ["lat", "lon"])
    mean = counted.agg((F.sum(F.col("n") * (digamma(F.col("n_lat")) + digamma(F.col("n_lon")))) / F.sum("n")).alias("m"), F.any_value(digamma(F.lit(float(s["n"])))).alias("all"), F.any_value(digamma(F.lit(float(k)))).alias("k")).first()
    for done in (points, balls):
        drop_cut(done)
    return max(0.0, mean["all"] + mean["k"] - mean["m"])


def correlations(df: DataFrame, pairs: list[tuple[str, str]], *by: str) -> DataFrame:
    """(by, x, y, n, r, p_value) of each pair of columns, over the rows where both are known, in one pass."""
    measures = []
    for a, b in pairs:
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        u, v = (F.when(known, F.col(c).cast("double")) for c in (a, b))
        measures.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(u).alias("n"), F.corr(u, v).alias("r")))
    out = df.groupBy(*by).agg(F.array(*measures).alias("m")).select(*by, F.explode("m").alias("m")).select(*by, "m.*")
    return out.withColumn("p_value", correlation_p_value(F.col("r"), F.col("n")))
