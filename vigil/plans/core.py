"""Queries on the calendar, rates, populations, cleaning, intervals and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import calendar as cal
from vigil.functions import scalars as sc
from vigil.functions.scalars import quantise as q
from vigil.operators import intervals, rates, series
from vigil.operators.shared import cut
from vigil.plans.frames import CASES, EPI_CASES, EXPOSURES, POPULATION, cases, epi_sql, exposed_lines, exposures, population, q_sql, table
from vigil.plans.registry import query

# --- calendar ---------------------------------------------------------------------------------


@query("cal_epi_week", f"SELECT case_id, dt, epidemic_year, week, epidemic_date FROM ({EPI_CASES})")
def cal_epi_week(spark, d):
    return cases(spark, d).select("case_id", "dt", "epidemic_year", "week", "epidemic_date")


@query("cal_biweek", f"SELECT biweek, count(*) AS n, min(dt) AS first_day, max(dt) AS last_day FROM ({EPI_CASES}) GROUP BY biweek")
def cal_biweek(spark, d):
    c = cases(spark, d)
    return c.groupBy(cal.biweek_of_label(F.col("epidemic_date")).alias("biweek")).agg(F.count("*").alias("n"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))


@query("cal_ordinal", f"SELECT DISTINCT epidemic_date, ey * 53 + week - 1 AS ordinal, TRUE AS valid FROM ({EPI_CASES})")
def cal_ordinal(spark, d):
    c = cases(spark, d).select("epidemic_date").distinct()
    return c.select("epidemic_date", cal.ordinal_of_label(F.col("epidemic_date")).alias("ordinal"), cal.is_label(F.col("epidemic_date")).alias("valid"))


@query("cal_june_week", "SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) BETWEEN s AND s + 6 AS same_week, CAST(o_orderdate AS DATE) - DATE '0001-01-01' + 1 AS ordinal_day FROM (SELECT *, make_date(year(o_orderdate), 6, 1) - CAST(dayofweek(make_date(year(o_orderdate), 6, 1)) AS INTEGER) AS s FROM orders)")
def cal_june_week(spark, d):
    dt = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), cal.same_week_as_june1(dt).alias("same_week"), cal.ordinal_day(dt).cast("bigint").alias("ordinal_day"))


@query("cal_week_spine", epi_sql("SELECT CAST(x AS DATE) AS dt FROM generate_series(DATE '1995-05-28', DATE '2001-05-26', INTERVAL 7 DAY) t(x)").replace("SELECT *, ylab", "SELECT dt AS week_start, ylab", 1).join(["SELECT epidemic_date, week_start FROM (", ")"]))
def cal_week_spine(spark, d):
    return cal.week_spine(spark, "1995_96W01", "2000_01W52")


@query("cal_label_ranges", f"SELECT epidemic_year, min(dt) AS first_day, max(dt) AS last_day, count(DISTINCT week) AS weeks FROM ({EPI_CASES}) GROUP BY epidemic_year")
def cal_label_ranges(spark, d):
    return cases(spark, d).groupBy("epidemic_year").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count_distinct("week").alias("weeks"))


@query("cal_text_dates", "SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%G%V') AS iso_compact, CAST(date_trunc('week', o_orderdate) AS DATE) AS iso_monday FROM orders")
def cal_text_dates(spark, d):
    o = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("dt", "yyyy-MM-dd")).otherwise(F.date_format("dt", "dd/MM/yyyy"))
    monday = F.date_sub("dt", F.weekday("dt"))
    iso_year = F.year(F.date_add(monday, 3)).cast("string")
    week = F.weekofyear("dt")
    return o.select(
        F.col("o_orderkey").alias("case_id"), cal.parse_date(text, "yyyy-MM-dd", "dd/MM/yyyy").alias("parsed"),
        cal.compact_iso_label(F.concat(iso_year, F.lit("W"), week.cast("string"))).alias("iso_compact"),
        cal.iso_label_to_date(F.concat(iso_year, F.lit("-W"), cal.pad2(week))).alias("iso_monday"),
    )


# --- rates and populations --------------------------------------------------------------------

_RATE = f"SELECT p.sector_id, p.biweek, coalesce(n, 0) AS case_count, population, CASE WHEN population > 0 THEN coalesce(n, 0) / CAST(population AS DOUBLE) * 1000.0 ELSE 0.0 END AS cases_per_1000 FROM ({POPULATION}) p LEFT JOIN (SELECT sector, biweek, count(*) AS n FROM ({EPI_CASES}) GROUP BY ALL) c ON c.sector = p.sector_id AND c.biweek = p.biweek"
_EB = f"""WITH r AS ({_RATE}), m AS (SELECT sum(case_count)::DOUBLE / sum(population) AS m, sum(population)::DOUBLE AS b, count(*) AS n FROM r WHERE population > 0),
  s AS (SELECT m, greatest(0.0, (SELECT sum(population * (case_count / population::DOUBLE - m) * (case_count / population::DOUBLE - m)) FROM r WHERE population > 0) / b - m / (b / n)) AS a FROM m)
  SELECT r.*, CASE WHEN population > 0 THEN (w * (case_count / population::DOUBLE) + (1 - w) * m) * 1000.0 ELSE 0.0 END AS eb FROM (SELECT r.*, m, CASE WHEN population > 0 THEN a / (a + m / population) ELSE 0 END AS w FROM r CROSS JOIN s) r"""


def _rated(spark, d):
    c = cases(spark, d).select(F.col("sector").alias("sector_id"), "biweek")
    return rates.per_capita(c, population(spark, d))


@query("rate_per_capita", f"SELECT sector_id, biweek, case_count, population, {q_sql('cases_per_1000')} AS cases_per_1000 FROM ({_RATE})")
def rate_per_capita(spark, d):
    return _rated(spark, d).withColumn("cases_per_1000", q(F.col("cases_per_1000")))


@query("rate_eb", f"SELECT sector_id, biweek, case_count, population, {q_sql('cases_per_1000')} AS cases_per_1000, {q_sql('eb')} AS eb_rate_per_1000 FROM ({_EB})")
def rate_eb(spark, d):
    out = rates.empirical_bayes(_rated(spark, d))
    return out.select("sector_id", "biweek", "case_count", "population", q(F.col("cases_per_1000")).alias("cases_per_1000"), q(F.col("eb_rate_per_1000")).alias("eb_rate_per_1000")).orderBy("sector_id", "biweek")


@query("rate_city", f"SELECT biweek, sum(case_count)::BIGINT AS cases, {q_sql('coalesce(sum(case_count) / nullif(sum(population), 0)::DOUBLE * 1000.0, 0)')} AS rate FROM ({_RATE}) GROUP BY biweek")
def rate_city(spark, d):
    g = _rated(spark, d).groupBy("biweek").agg(F.sum("case_count").alias("cases"), F.sum("population").alias("p"))
    return g.select("biweek", "cases", q(F.coalesce(F.try_divide(F.col("cases"), F.col("p")) * 1000.0, F.lit(0.0))).alias("rate"))


_SECTORS = "SELECT n_nationkey::VARCHAR AS sector_id, 200 + n_nationkey * 31 AS population_2010, 260 + ((n_nationkey * 17) % 23) * 29 AS population_2022 FROM nation"


def _sectors(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("string").alias("sector_id"), (200 + k * 31).alias("population_2010"), (260 + ((k * 17) % 23) * 29).alias("population_2022"))


@query("pop_line", f"SELECT sector_id, epidemic_date, CAST(floor(population_2010 + (population_2022 - population_2010) / 636.0::DOUBLE * (o - 2010 * 53 - 0) + 0.5) AS BIGINT) AS population FROM ({_SECTORS}) CROSS JOIN (SELECT DISTINCT epidemic_date, ey * 53 + week - 1 AS o FROM ({EPI_CASES}))")
def pop_line(spark, d):
    return rates.population_line(_sectors(spark, d), cases(spark, d).select("epidemic_date"), "2010_11W01", "2022_23W01")


_FRACTION = f"SELECT sector_id, epidemic_date, CAST(floor(greatest(population_2010 + (population_2022 - population_2010) * ((i - 1) / CAST(n - 1 AS DOUBLE)), 0.0) + 0.5) AS BIGINT) AS population FROM ({_SECTORS}) CROSS JOIN (SELECT epidemic_date, row_number() OVER (ORDER BY epidemic_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT epidemic_date FROM ({EPI_CASES})))"


@query("pop_fraction", _FRACTION)
def pop_fraction(spark, d):
    return rates.population_fraction(_sectors(spark, d), cases(spark, d).select("epidemic_date"))


@query("pop_biweekly", f"SELECT sector_id, split_part(epidemic_date, 'W', 1) || 'W' || lpad(CAST(((CAST(split_part(epidemic_date, 'W', 2) AS INTEGER) + 1) // 2) * 2 AS VARCHAR), 2, '0') AS biweek, CAST(greatest(round_even(avg(population), 0), 0) AS BIGINT) AS population FROM ({_FRACTION}) GROUP BY ALL")
def pop_biweekly(spark, d):
    return rates.weekly_to_biweekly(pop_fraction(spark, d))


_LINKS = "SELECT l_partkey AS source, l_suppkey AS target, a / sum(a) OVER (PARTITION BY l_partkey) AS fraction, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS population FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS a FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey"


def _links(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("a"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    out = a.join(p, "l_partkey").withColumn("fraction", F.col("a") / F.sum("a").over(Window.partitionBy("l_partkey")))
    return out.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), "fraction", F.when(F.col("l_partkey") % 11 != 0, F.col("p_retailprice")).alias("population"))


@query("pop_redistribute", f"SELECT target, CAST(floor(sum(population * fraction) + 0.5) AS BIGINT) AS population, count(*) AS n_sources, CASE WHEN count(*) = 1 AND max(fraction) >= 0.8 THEN 'maintained' WHEN count(*) = 1 THEN 'subdivided' ELSE 'aggregated' END AS conversion FROM ({_LINKS}) WHERE population IS NOT NULL GROUP BY target HAVING sum(population * fraction) > 0")
def pop_redistribute(spark, d):
    return rates.redistribute(_links(spark, d))


@query("pop_conservation", f"SELECT {q_sql('sum(moved) / sum(p) * 100', 4)} AS conserved_percent FROM (SELECT source, min(population) AS p, sum(population * fraction) AS moved FROM ({_LINKS}) WHERE population IS NOT NULL GROUP BY source)")
def pop_conservation(spark, d):
    return rates.conservation(_links(spark, d)).select(q(F.col("conserved_percent"), 4).alias("conserved_percent"))


@query("pop_cardinality", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s = 1 AND t = 1 THEN '1:1' WHEN s > 1 AND t = 1 THEN '1:N' WHEN s = 1 THEN 'N:1' ELSE 'N:M' END AS kind FROM (SELECT count(*) OVER (PARTITION BY source) AS s, count(*) OVER (PARTITION BY target) AS t FROM ({_LINKS}))) GROUP BY kind")
def pop_cardinality(spark, d):
    w = _links(spark, d).select(F.count("*").over(Window.partitionBy("source")).alias("s"), F.count("*").over(Window.partitionBy("target")).alias("t"))
    kind = F.when((F.col("s") == 1) & (F.col("t") == 1), "1:1").when((F.col("s") > 1) & (F.col("t") == 1), "1:N").when(F.col("s") == 1, "N:1").otherwise("N:M")
    return w.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- intervals --------------------------------------------------------------------------------

_RAW = "SELECT l_suppkey || '-' || (l_orderkey * 10 + l_linenumber) AS sample, l_suppkey AS trap, CAST(o_orderdate AS DATE) AS dt_instal, CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) ELSE CAST(o_orderdate AS DATE) + CAST(l_linenumber * 2 AS INTEGER) END AS dt_col, CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE q END AS novos FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3) JOIN orders ON l_orderkey = o_orderkey"


def _raw(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("ship"), F.sum("l_quantity").alias("q"))
    j = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.to_date("o_orderdate")
    end = F.when(F.col("l_orderkey") % 97 == 0, None).when(F.col("l_linenumber") % 3 == 0, F.to_date("ship")).otherwise(F.date_add(start, F.col("l_linenumber") * 2))
    return j.select(F.concat_ws("-", "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_suppkey").alias("trap"), start.alias("dt_instal"), end.alias("dt_col"), F.when(F.col("l_orderkey") % 53 != 0, F.col("q")).alias("novos"))


_REPAIR = f"""WITH a AS (SELECT * REPLACE (CASE WHEN dt_col IS NULL OR dt_col <= dt_instal THEN dt_instal + 7 ELSE dt_col END AS dt_col) FROM ({_RAW})),
  b AS (SELECT *, lead(dt_instal) OVER (PARTITION BY trap ORDER BY dt_instal, dt_col, sample) AS nx FROM a),
  c AS (SELECT * EXCLUDE nx REPLACE (CASE WHEN dt_col >= nx THEN dt_instal + 7 ELSE dt_col END AS dt_col) FROM b WHERE novos IS NOT NULL),
  e AS (SELECT * REPLACE (CASE WHEN dt_col - dt_instal > 21 OR dt_col - dt_instal < 4 THEN dt_instal + 7 ELSE dt_col END AS dt_col) FROM c)
  SELECT *, CAST(dt_col - dt_instal AS INTEGER) AS days_expo, novos / (dt_col - dt_instal) AS eggs_per_day FROM e"""


@query("clean_date_repair", f"SELECT * REPLACE ({q_sql('eggs_per_day')} AS eggs_per_day) FROM ({_REPAIR})")
def clean_date_repair(spark, d):
    return intervals.repair_dates(_raw(spark, d)).withColumn("eggs_per_day", q(F.col("eggs_per_day")))


@query("iv_overlap", f"SELECT trap, sample AS first, nk AS second FROM (SELECT *, lead(dt_instal) OVER w AS ns, lead(sample) OVER w AS nk FROM ({EXPOSURES}) WINDOW w AS (PARTITION BY trap ORDER BY dt_instal, dt_col, sample)) WHERE dt_col >= ns")
def iv_overlap(spark, d):
    return intervals.overlaps(exposures(spark, d))


@query("iv_daily_spread", f"SELECT trap, CAST(day AS DATE) AS day, {q_sql('sum(v)', 4)} AS eggs FROM (SELECT trap, eggs / (dt_col - dt_instal) AS v, unnest(generate_series(dt_instal, dt_col - 1, INTERVAL 1 DAY)) AS day FROM ({EXPOSURES})) GROUP BY ALL")
def iv_daily_spread(spark, d):
    return intervals.daily_spread(exposed_lines(spark, d)).withColumn("eggs", q(F.col("eggs"), 4))


@query("iv_gap_days", f"SELECT gap_days, count(*) AS n FROM (SELECT CAST(dt_col - lag(dt_col) OVER (PARTITION BY trap ORDER BY dt_col) AS INTEGER) AS gap_days FROM (SELECT DISTINCT trap, dt_col FROM ({EXPOSURES}))) GROUP BY gap_days")
def iv_gap_days(spark, d):
    return intervals.gaps(exposures(spark, d).select("trap", "dt_col").distinct()).groupBy("gap_days").agg(F.count("*").alias("n"))


@query("iv_range_label", f"WITH r AS (SELECT epidemic_year AS label, min(dt) AS a, max(dt) AS b FROM ({EPI_CASES}) WHERE flag = 'F' GROUP BY 1) SELECT label, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS dt FROM orders) o JOIN r ON dt BETWEEN a AND b GROUP BY label")
def iv_range_label(spark, d):
    r = cases(spark, d).where("flag = 'F'").groupBy(F.col("epidemic_year").alias("label")).agg(F.min("dt").alias("start"), F.max("dt").alias("end"))
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt"))
    return intervals.label_dates(o, r).groupBy("label").agg(F.count("*").alias("n"))


@query("iv_next_previous", f"SELECT trap, dt_instal, lag(dt_instal) OVER w AS previous, lead(dt_instal) OVER w AS next FROM (SELECT DISTINCT trap, dt_instal FROM ({EXPOSURES})) WINDOW w AS (PARTITION BY trap ORDER BY dt_instal)")
def iv_next_previous(spark, d):
    w = Window.partitionBy("trap").orderBy("dt_instal")
    return exposures(spark, d).select("trap", "dt_instal").distinct().select("trap", "dt_instal", F.lag("dt_instal").over(w).alias("previous"), F.lead("dt_instal").over(w).alias("next"))


@query("iv_trailing_window", f"SELECT trap, dt_instal, k, count(o_orderkey) AS n_before FROM (SELECT DISTINCT trap, dt_instal, k FROM ({EXPOSURES})) e LEFT JOIN orders o ON CAST(o_orderdate AS DATE) >= dt_instal - 7 AND CAST(o_orderdate AS DATE) < dt_instal GROUP BY ALL")
def iv_trailing_window(spark, d):
    e = exposures(spark, d).select("trap", "dt_instal", "k").distinct()
    per_day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    # Each day's orders count for the seven days after it: a row a day, so exposures meet one sum and aren't spread.
    after = per_day.where("day is not null").select(F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 7))).alias("dt_instal"), "n").groupBy("dt_instal").agg(F.sum("n").alias("n"))
    return e.join(F.broadcast(after), "dt_instal", "left").select("trap", "dt_instal", "k", F.coalesce("n", F.lit(0)).alias("n_before"))


# --- series -----------------------------------------------------------------------------------

_DAILY = "SELECT CAST(day AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS dd, count(*) AS n FROM orders GROUP BY 1) ON dd = CAST(day AS DATE)"


@query("ser_daily_dense", _DAILY)
def ser_daily_dense(spark, d):
    n = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return intervals.dense_days(n, fill=0)


_WEEKLY = f"SELECT s.epidemic_date, coalesce(n, 0) AS n, eggs FROM (SELECT DISTINCT epidemic_date FROM ({epi_sql(_DAILY.replace('AS day,', 'AS dt,'))})) s LEFT JOIN (SELECT epidemic_date, count(*) AS n, sum(CASE WHEN flag = 'F' THEN v END) AS eggs FROM ({EPI_CASES}) GROUP BY 1) c USING (epidemic_date)"


def _weekly(spark, d):
    """epidemic_date, n (0 where none), eggs (null where none) for every week of the cases: a few hundred rows, computed once and stored."""
    c = cases(spark, d)
    days = intervals.dense_days(c.select(F.col("dt").alias("day")).distinct())
    spine = days.select(cal.week_label(F.col("day")).alias("epidemic_date")).distinct()
    g = c.groupBy("epidemic_date").agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag") == "F", F.col("v"))).alias("eggs"))
    return cut(spine.join(g, "epidemic_date", "left").select("epidemic_date", F.coalesce("n", F.lit(0)).alias("n"), "eggs"), "weekly")


@query("ser_weekly_dense", f"SELECT epidemic_date, n, {q_sql('eggs', 2)} AS eggs FROM ({_WEEKLY})")
def ser_weekly_dense(spark, d):
    return _weekly(spark, d).withColumn("eggs", q(F.col("eggs"), 2))


_FLAGS = ["F", "O", "P"]


@query("ser_biweekly_pivot", f"SELECT biweek, {', '.join(f'''count(*) FILTER (flag = '{x}') AS {x}''' for x in _FLAGS)} FROM ({EPI_CASES}) GROUP BY biweek")
def ser_biweekly_pivot(spark, d):
    return cases(spark, d).groupBy("biweek").pivot("flag", _FLAGS).agg(F.count("case_id")).na.fill(0, _FLAGS)


@query("ser_lags", f"SELECT *, lag(n, 1) OVER w AS lag1, lag(n, 2) OVER w AS lag2, lag(n, 3) OVER w AS lag3, lead(n) OVER w AS target FROM (SELECT epidemic_date, n FROM ({_WEEKLY})) WINDOW w AS (ORDER BY epidemic_date)")
def ser_lags(spark, d):
    s = _weekly(spark, d).select("epidemic_date", "n")
    return series.next_value(series.lags(s, "n", 3, "epidemic_date"), "n", "epidemic_date")


_TRAPDAY = f"SELECT trap, dt_col, sum(CASE WHEN eggs < 12 THEN 0 ELSE eggs END) AS v FROM ({EXPOSURES}) GROUP BY ALL"


def _trapday(spark, d):
    return exposures(spark, d).groupBy("trap", "dt_col").agg(F.sum(F.when(F.col("eggs") < 12, 0.0).otherwise(F.col("eggs"))).alias("v"))


@query("ser_expanding_zero", f"SELECT trap, dt_col, {q_sql('sum(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) OVER w / nullif(count(v) OVER w, 0)')} AS zero_share FROM ({_TRAPDAY}) WINDOW w AS (PARTITION BY trap ORDER BY dt_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ser_expanding_zero(spark, d):
    return series.expanding_zero_share(_trapday(spark, d), "v", "dt_col", ["trap"]).select("trap", "dt_col", q(F.col("zero_share")).alias("zero_share"))


@query("ser_group", f"SELECT bucket, min(epidemic_date) AS epidemic_date, sum(n)::DOUBLE AS n FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY epidemic_date) - 1 - 3) / 4.0) AS INTEGER) AS bucket FROM ({_WEEKLY})) GROUP BY bucket")
def ser_group(spark, d):
    s = _weekly(spark, d).withColumn("n", F.col("n").cast("double"))
    return series.group_series(s, "n", 4, 3, "epidemic_date")


_PAIR = f"SELECT epidemic_date AS label, CAST(n AS DOUBLE) AS x, CASE WHEN n % 7 = 0 THEN NULL ELSE eggs END AS y FROM ({_WEEKLY})"


def _pair(spark, d):
    return _weekly(spark, d).select(F.col("epidemic_date").alias("label"), F.col("n").cast("double").alias("x"), F.when(F.col("n") % 7 != 0, F.col("eggs")).alias("y"))


_CORR = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
_XCORR = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS p FROM ({_PAIR})), e AS (SELECT least(max(p) FILTER (x IS NOT NULL), max(p) FILTER (y IS NOT NULL)) AS last FROM p),
  k AS (SELECT p.* FROM p, e WHERE p < last), l AS (SELECT unnest(generate_series(-8, 8)) AS lag)
  SELECT CAST(lag AS INTEGER) AS lag, covar_pop(x, y) FILTER (x IS NOT NULL AND y IS NOT NULL) / nullif(stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL), 0) AS corr, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n
  FROM (SELECT lag, a.x, b.y FROM k b CROSS JOIN l JOIN k a ON a.p = b.p + lag) GROUP BY lag"""


@query("ser_xcorr", f"SELECT lag, {q_sql('corr')} AS corr, n FROM ({_XCORR})")
def ser_xcorr(spark, d):
    return series.lagged_correlation(_pair(spark, d), "x", "y", 8).withColumn("corr", q(F.col("corr")))


@query("ser_best_lag", f"SELECT lag, {q_sql('corr')} AS corr FROM ({_XCORR}) WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, lag LIMIT 1")
def ser_best_lag(spark, d):
    return series.best_lag(series.lagged_correlation(_pair(spark, d), "x", "y", 8)).withColumn("corr", q(F.col("corr")))


@query("ser_sweep", f"""WITH p AS (SELECT n::DOUBLE AS x, coalesce(eggs, 0) AS y, row_number() OVER (ORDER BY epidemic_date) - 1 AS p FROM ({_WEEKLY})), g AS (SELECT unnest(generate_series(1, 60)) AS g),
  b AS (SELECT g, p // g AS b, sum(x) AS x, sum(y) AS y FROM p CROSS JOIN g GROUP BY ALL), l AS (SELECT unnest(generate_series(0, 120)) AS lag)
  SELECT CAST(g AS INTEGER) AS g, CAST(lag AS INTEGER) AS lag, {q_sql(_CORR)} AS corr, count(*) AS n FROM (SELECT a.g, lag, a.x, c.y FROM b a CROSS JOIN l JOIN b c ON c.g = a.g AND c.b = a.b + lag WHERE lag <= ceil(120.0 / a.g)) GROUP BY ALL""")  # fmt: skip
def ser_sweep(spark, d):
    p = _weekly(spark, d).select(F.col("n").cast("double").alias("x"), F.coalesce("eggs", F.lit(0.0)).alias("y"), (F.row_number().over(Window.orderBy("epidemic_date")) - 1).alias("p"))
    b = p.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(60)))).groupBy("g", F.floor(F.col("p") / F.col("g")).alias("b")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    later = b.select("g", "y", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(120) / F.col("g")).cast("int"))).alias("lag"), (F.col("b") - F.col("lag")).alias("b"))
    return b.select("g", "b", "x").join(later, ["g", "b"]).groupBy("g", "lag").agg(q(series.correlation("x", "y")).alias("corr"), F.count("*").alias("n"))


@query("ser_corr_by_year", f"SELECT substr(label, 1, 7) AS epidemic_year, substr(label, 1, 7) IN ('1998_99', '2000_01') AS epidemic, {q_sql(_CORR)} AS corr FROM (SELECT * FROM ({_PAIR}) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY 1")
def ser_corr_by_year(spark, d):
    year = F.substring("label", 1, 7)
    return _pair(spark, d).groupBy(year.alias("epidemic_year")).agg(q(series.correlation("x", "y")).alias("corr")).withColumn("epidemic", F.col("epidemic_year").isin("1998_99", "2000_01"))


for _method, _sql in (("zscore", "(x - avg(x) OVER ()) / nullif(stddev_samp(x) OVER (), 0)"), ("minmax", "(x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0)"), ("l2", "x / nullif(sqrt(sum(x * x) OVER ()), 0)")):

    def _norm(spark, d, method=_method):
        return series.normalise(_pair(spark, d), "x", method).select("label", q(F.col(method)).alias("value"))

    query(f"ser_norm_{_method}", f"SELECT label, {q_sql(_sql)} AS value FROM ({_PAIR})")(_norm)


@query("ser_fill", f"""WITH p AS (SELECT label, y, row_number() OVER (ORDER BY label) AS p FROM ({_PAIR})),
  f AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS ff, first_value(y IGNORE NULLS) OVER a AS bf, max(CASE WHEN y IS NOT NULL THEN p END) OVER b AS l, min(CASE WHEN y IS NOT NULL THEN p END) OVER a AS h FROM p
  WINDOW b AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT label, {q_sql('ff', 3)} AS ffill, {q_sql('bf', 3)} AS bfill, {q_sql('CASE WHEN y IS NOT NULL THEN y WHEN ff IS NULL THEN NULL WHEN bf IS NULL THEN ff ELSE ff + (bf - ff) * ((p - l)::DOUBLE / (h - l)) END', 3)} AS linear FROM f""")  # fmt: skip
def ser_fill(spark, d):
    f = series.fill(_pair(spark, d), "y")
    return f.select("label", *[q(F.col(c), 3).alias(c) for c in ("ffill", "bfill", "linear")])


@query("ser_window_samples", f"SELECT label, {q_sql('list_sum(w)', 3)} AS total FROM (SELECT label, list(y) FILTER (y IS NOT NULL) OVER (ORDER BY label ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM ({_PAIR})) WHERE len(w) = 5")
def ser_window_samples(spark, d):
    return series.sample_windows(_pair(spark, d), "y", 5).select("label", q(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("ser_peak", f"WITH s AS (SELECT trap, dt_col, v, row_number() OVER (PARTITION BY trap ORDER BY dt_col) AS i FROM ({_TRAPDAY})), t AS (SELECT *, max(v) OVER (PARTITION BY trap) AS m FROM s) SELECT trap, dt_col, CAST(i - min(CASE WHEN v = m THEN i END) OVER (PARTITION BY trap) AS INTEGER) AS from_peak, {q_sql('v / nullif(m, 0)')} AS of_peak FROM t")
def ser_peak(spark, d):
    return series.peak(_trapday(spark, d), "v", "dt_col", ["trap"]).select("trap", "dt_col", "from_peak", q(F.col("of_peak")).alias("of_peak"))


@query("ser_acf", f"WITH p AS (SELECT coalesce(y, 0) AS y, row_number() OVER (ORDER BY label) AS p FROM ({_PAIR})), m AS (SELECT avg(y) AS m, sum((y - (SELECT avg(y) FROM p)) * (y - (SELECT avg(y) FROM p))) AS s FROM p) SELECT CAST(lag AS INTEGER) AS lag, {q_sql('sum((a.y - m) * (b.y - m)) / max(s)')} AS acf FROM p a CROSS JOIN (SELECT unnest(generate_series(1, 207)) AS lag) JOIN p b ON b.p = a.p + lag CROSS JOIN m GROUP BY lag")
def ser_acf(spark, d):
    p = _pair(spark, d).select(F.coalesce("y", F.lit(0.0)).alias("y"), F.row_number().over(Window.orderBy("label")).alias("p"))
    m = p.agg(F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("s"))
    c = p.crossJoin(F.broadcast(m)).select("p", (F.col("y") - F.col("m")).alias("c"), "s")
    later = c.select("s", F.col("c").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(207))).alias("lag"), F.col("p").alias("o")).withColumn("p", F.col("o") - F.col("lag")).drop("o")
    return c.select("p", "c").join(later, "p").groupBy("lag").agg(q(F.try_divide(F.sum(F.col("c") * F.col("e")), F.max("s"))).alias("acf"))


@query("ser_mutual_information")
def ser_mutual_information(spark, d):
    """A binned estimate: rows are checked, and a test compares it with a brute-force count."""
    return series.mutual_information(_pair(spark, d), "x", "y")


# --- cleaning and scalar functions --------------------------------------------------------------


@query("clean_dedup", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def clean_dedup(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()


@query("clean_flag_filter", f"SELECT f, count(*) AS n FROM (SELECT CASE WHEN case_id % 9 = 0 THEN NULL ELSE flag END AS f FROM ({CASES})) WHERE f IS DISTINCT FROM 'P' GROUP BY f")
def clean_flag_filter(spark, d):
    f = cases(spark, d).select(F.when(F.col("case_id") % 9 != 0, F.col("flag")).alias("f"))
    return f.where(~F.col("f").eqNullSafe("P")).groupBy("f").agg(F.count("*").alias("n"))


@query("clean_point_patch", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey * 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def clean_point_patch(spark, d):
    s = table(spark, d, "supplier")
    patches = s.where("s_suppkey % 7 = 0").select("s_suppkey", (F.col("s_suppkey") * F.lit(1.5)).alias("new_value"))
    return intervals.patch(s, patches, ["s_suppkey"], "s_acctbal").select("s_suppkey", "s_acctbal")


@query("clean_sentinels", f"SELECT s_suppkey, CASE WHEN s_acctbal IN (-9999, 0) OR s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS v, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END = 1 AND s_nationkey <> 0 AS located, {q_sql('least(greatest(s_acctbal, 0), 100)', 3)} AS clipped FROM supplier")
def clean_sentinels(spark, d):
    s = table(spark, d, "supplier").withColumn("a", F.when(F.col("s_suppkey") % 5 == 0, F.lit(-9999.0)).otherwise(F.col("s_acctbal")))
    return s.select("s_suppkey", sc.null_if(F.col("a"), -9999.0, 0.0).alias("v"), (sc.null_if(F.col("a"), -9999.0).isNotNull() & (F.col("s_nationkey") != 0)).alias("located"), q(sc.clip(F.col("s_acctbal"), 0.0, 100.0), 3).alias("clipped"))


@query("fn_scalars", "SELECT p_partkey, CAST(floor(p_retailprice / 7 + 0.5) AS BIGINT) AS half_up, CAST('90' || p_partkey AS BIGINT) AS prefixed, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS bin_right, CAST(least(floor(p_size / 10.0), 3) AS INTEGER) AS bin_left, CASE WHEN p_size > 20 THEN 1 ELSE -1 END AS flag, replace(replace(CAST(p_size AS VARCHAR) || ',5', ',', '.'), ' ', '')::DOUBLE AS comma, CAST(right(CAST(200000 + p_size AS VARCHAR), 2) AS INTEGER) AS week, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'ad' ELSE '' END AS label FROM part")
def fn_scalars(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    return p.select(
        "p_partkey", sc.half_up(F.col("p_retailprice") / 7).alias("half_up"), sc.prefixed_id(F.col("p_partkey")).alias("prefixed"), sc.right_closed_bins(size, [10, 25]).alias("bin_right"),
        sc.left_closed_bins(size, 10, 3).alias("bin_left"), sc.above(size, 20, -1).alias("flag"), sc.comma_decimal(F.concat(size.cast("string"), F.lit(",5"))).alias("comma"),
        sc.last_two(size + 200000).alias("week"), sc.label_lookup(F.col("p_type"), {"ECONOMY": "low", "PROMO": "ad"}).alias("label"),
    )


@query("fn_text", "SELECT s_suppkey, split_part(s_name, '#', 2) AS part, regexp_extract(s_name, '(\\d{4})', 1) AS digits, s_name LIKE 'Supplier%' AS starts, s_name ILIKE '%LIER%' AS has, concat_ws('/', s_name, s_nationkey) AS key, CASE WHEN length(s_suppkey::VARCHAR) >= 2 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 2, '0') END AS padded FROM supplier")
def fn_text(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), F.regexp_extract(n, r"(\d{4})", 1).alias("digits"), n.startswith("Supplier").alias("starts"), n.ilike("%LIER%").alias("has"), F.concat_ws("/", n, F.col("s_nationkey").cast("string")).alias("key"), cal.pad2(F.col("s_suppkey")).alias("padded"))


@query("fn_rowwise", f"SELECT l_orderkey, l_linenumber, l_partkey, {q_sql('(l_discount + l_tax + l_quantity) / 3')} AS mean3, {q_sql('list_median([l_discount, l_tax, l_quantity])')} AS median3 FROM lineitem")
def fn_rowwise(spark, d):
    cols = [F.col(c) for c in ("l_discount", "l_tax", "l_quantity")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q(sc.row_mean(*cols)).alias("mean3"), q(sc.row_median(*cols)).alias("median3"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_NAIVE_SERIES = f"SELECT epidemic_date, n::DOUBLE AS y, lag(n, 1) OVER (ORDER BY epidemic_date)::DOUBLE AS x, lag(n, 2) OVER (ORDER BY epidemic_date)::DOUBLE AS z FROM ({_WEEKLY})"
