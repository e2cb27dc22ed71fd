"""Domain roles of the test tables, as DataFrames and as SQL.

Orders stand for dated case notices, order lines for exposures of traps (suppliers), nations for areas; places
come from integer arithmetic on keys, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import calendar as cal


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lat(key: str):
    return F.lit(-20.03) + ((F.col(key) * 37) % 260) / F.lit(1000.0)


def lon(key: str):
    return F.lit(-44.06) + ((F.col(key) * 53) % 190) / F.lit(1000.0)


def lat_sql(key: str) -> str:
    return f"(-20.03::DOUBLE + ((({key}) * 37) % 260) / 1000.0::DOUBLE)"


def lon_sql(key: str) -> str:
    return f"(-44.06::DOUBLE + ((({key}) * 53) % 190) / 1000.0::DOUBLE)"


def q_sql(x: str, places: int = 6) -> str:
    unit = f"{10 ** places}.0::DOUBLE"
    return f"(floor(({x}) * {unit} + 0.5::DOUBLE) / {unit})"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """case_id, dt, sector, flag, v, epidemic_date, biweek."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("dt"), F.col("c_nationkey").alias("sector"), F.col("o_orderstatus").alias("flag"), F.col("o_totalprice").alias("v"), F.col("c_custkey").alias("place")
    )
    return df.withColumns({"epidemic_year": cal.year_label(cal.epidemic_year(F.col("dt"))), "week": cal.epidemic_week(F.col("dt")), "epidemic_date": cal.week_label(F.col("dt")), "biweek": cal.biweek_label(F.col("dt"))})


def epi_sql(inner: str, date: str = "dt") -> str:
    """``inner`` with the calendar's columns."""
    start = lambda y: f"(make_date({y}, 6, 1) - CAST(dayofweek(make_date({y}, 6, 1)) AS INTEGER))"
    return f"""SELECT *, ylab AS epidemic_year, ylab || 'W' || lpad(CAST(week AS VARCHAR), 2, '0') AS epidemic_date,
      ylab || 'W' || lpad(CAST(((week + 1) // 2) * 2 AS VARCHAR), 2, '0') AS biweek FROM (
      SELECT *, CAST((CAST({date} AS DATE) - {start('ey')}) // 7 + 1 AS INTEGER) AS week, ey || '_' || lpad(CAST((ey + 1) % 100 AS VARCHAR), 2, '0') AS ylab FROM (
      SELECT *, CAST(CASE WHEN {date} >= {start(f'year({date})')} THEN year({date}) ELSE year({date}) - 1 END AS INTEGER) AS ey FROM ({inner})))"""


CASES = "SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS dt, c_nationkey AS sector, o_orderstatus AS flag, o_totalprice AS v, c_custkey AS place FROM orders JOIN customer ON o_custkey = c_custkey"
EPI_CASES = epi_sql(CASES)


def exposed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The order lines that ``exposures`` adds up to samples; sums over exposures are sums over these."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_suppkey").alias("trap"), F.to_date("o_orderdate").alias("dt_instal"), F.date_add(F.to_date("o_orderdate"), 4 + F.col("l_linenumber")).alias("dt_col"), F.col("l_quantity").alias("eggs"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("p"))


def exposures(spark: SparkSession, d: str) -> DataFrame:
    """sample, trap, dt_instal, dt_col, eggs with clean intervals; one sample a (trap, order, line)."""
    return exposed_lines(spark, d).groupBy("trap", "dt_instal", "dt_col", "k").agg(F.sum("eggs").alias("eggs"), F.min("p").alias("p")).withColumn("sample", F.concat_ws("-", "trap", "k"))


EXPOSURES = """SELECT trap, dt_instal, dt_col, k, sum(eggs) AS eggs, min(p) AS p, trap || '-' || k AS sample FROM (
  SELECT l_suppkey AS trap, CAST(o_orderdate AS DATE) AS dt_instal, CAST(o_orderdate AS DATE) + CAST(4 + l_linenumber AS INTEGER) AS dt_col, l_quantity AS eggs, l_orderkey * 10 + l_linenumber AS k, l_partkey AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY trap, dt_instal, dt_col, k"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    """A 5 x 5 lattice of rectangles keyed by nation."""
    k = F.col("n_nationkey")
    x0, y0 = F.lit(-44.06) + (k % 5) * 0.038, F.lit(-20.03) + F.floor(k / 5) * 0.052
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.038, 0.0), corner(0.038, 0.052), corner(0.0, 0.052), corner(0.0, 0.0))
    return table(spark, d, "nation").select(k.alias("area"), ring.alias("ring"), x0.alias("x0"), y0.alias("y0"))


AREAS = "SELECT n_nationkey AS area, -44.06::DOUBLE + (n_nationkey % 5) * 0.038::DOUBLE AS x0, -20.03::DOUBLE + floor(n_nationkey / 5.0) * 0.052::DOUBLE AS y0 FROM nation"


def population(spark: SparkSession, d: str) -> DataFrame:
    """sector_id, biweek, population for every sector and every biweek of the cases; some sectors are empty."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("sector_id"))
    spine = cases(spark, d).select("biweek").distinct()
    return n.crossJoin(F.broadcast(spine)).select("sector_id", "biweek", F.when(F.col("sector_id") % 6 == 5, 0).otherwise(100 + F.col("sector_id") * 37).cast("bigint").alias("population"))


POPULATION = f"SELECT n_nationkey AS sector_id, biweek, CAST(CASE WHEN n_nationkey % 6 = 5 THEN 0 ELSE 100 + n_nationkey * 37 END AS BIGINT) AS population FROM nation CROSS JOIN (SELECT DISTINCT biweek FROM ({EPI_CASES}))"
