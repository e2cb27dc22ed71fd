"""Counts per area and period, crude and smoothed rates, redistribution and projection of populations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import half_up, per_thousand


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def count_by(df: DataFrame, *keys: str, name: str = "case_count") -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return require_columns(df, keys).dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def per_capita(cases: DataFrame, population: DataFrame, area: str = "sector_id", period: str = "biweek") -> DataFrame:
    """All rows of ``population`` with counts (0 where there is none) and cases per 1,000."""
    require_columns(population, [area, period, "population"])
    joined = population.join(count_by(cases, area, period), [area, period], "left").withColumn("case_count", F.coalesce("case_count", F.lit(0)))
    return joined.withColumn("cases_per_1000", per_thousand(F.col("case_count"), F.col("population")))


def empirical_bayes(df: DataFrame, events: str = "case_count", population: str = "population", multiplier: float = 1000.0, name: str = "eb_rate_per_1000") -> DataFrame:
    """Global empirical Bayes rates (Marshall, 1991), one pass for the moments and a one-row broadcast.

    m = sum(e) / sum(b), s2 = sum(b (r - m)^2) / sum(b), a = max(0, s2 - m / mean(b)); the weight of a row's own rate
    is a / (a + m / b). Rows whose population is not positive take no part and get 0.
    """
    e, b = F.col(events).cast("double"), F.col(population).cast("double")
    ok = b > 0
    sums = df.where(ok).agg(F.sum(e).alias("_e"), F.sum(b).alias("_b"), F.count("*").alias("_n"), F.sum(e * e / b).alias("_q"))
    m = F.try_divide(F.col("_e"), F.col("_b"))
    # sum(b (r - m)^2) = sum(e^2 / b) - m sum(e)
    a = F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - m * F.col("_e"), F.col("_b")) - m * F.try_divide(F.col("_n"), F.col("_b")))
    moments = sums.select(m.alias("_m"), a.alias("_a"))
    out = df.crossJoin(F.broadcast(moments))  # one row
    w = F.coalesce(F.try_divide(F.col("_a"), F.col("_a") + F.try_divide(F.col("_m"), b)), F.lit(0.0))
    rate = (w * F.try_divide(e, b) + (1 - w) * F.col("_m")) * multiplier
    return out.withColumn(name, F.when(ok, rate).otherwise(F.lit(0.0))).drop("_m", "_a")


def population_line(df: DataFrame, weeks: DataFrame, first: str = "2010_11W01", last: str = "2022_23W01") -> DataFrame:
    """Straight line through two anchor weeks, carried on beyond them: (sector_id, epidemic_date, population).

    ``weeks`` (epidemic_date) holds labels, so it is bounded by the calendar; values are rounded half up, not clamped.
    """
    from vigil.functions.calendar import ordinal_of_label

    a, b = ordinal_of_label(F.lit(first)), ordinal_of_label(F.lit(last))
    at = ordinal_of_label(F.col("epidemic_date"))
    value = F.col("population_2010") + (F.col("population_2022") - F.col("population_2010")) / (b - a) * (at - a)
    return df.crossJoin(F.broadcast(weeks.select("epidemic_date").distinct())).select("sector_id", "epidemic_date", half_up(value).alias("population"))


def population_fraction(df: DataFrame, weeks: DataFrame) -> DataFrame:
    """Interpolation over the position of a week between the first and the last, clamped at 0."""
    from pyspark.sql import Window

    order = Window.orderBy("epidemic_date")  # labels: a few thousand rows at most
    spine = weeks.select("epidemic_date").distinct().withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    f = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(0.0)
    value = F.greatest(F.col("population_2010") + (F.col("population_2022") - F.col("population_2010")) * f, F.lit(0.0))
    return df.crossJoin(F.broadcast(spine)).select("sector_id", "epidemic_date", half_up(value).alias("population"))


def weekly_to_biweekly(population: DataFrame) -> DataFrame:
    """Mean of a biweek's weeks, rounded half to even, not below 0."""
    from vigil.functions.calendar import biweek_of_label

    return (
        population.withColumn("biweek", biweek_of_label(F.col("epidemic_date"))).groupBy("sector_id", "biweek")
        .agg(F.greatest(F.bround(F.avg("population"), 0), F.lit(0.0)).cast("bigint").alias("population"))
    )


def redistribute(links: DataFrame, maintained: float = 0.8) -> DataFrame:
    """Population of each target from its sources' shares, with its class.

    ``links``: source, target, fraction, population (of the source). Links without a population don't count; targets
    without people are left out. One source with a share of ``maintained`` or more: maintained; one below: subdivided;
    several: aggregated.
    """
    known = links.where("population is not null and fraction is not null")
    share = F.col("population") * F.col("fraction")
    out = known.groupBy("target").agg(F.sum(share).alias("total"), F.count("*").alias("n_sources"), F.max("fraction").alias("_f"))
    kind = F.when((F.col("n_sources") == 1) & (F.col("_f") >= maintained), "maintained").when(F.col("n_sources") == 1, "subdivided").otherwise("aggregated")
    return out.where("total > 0").select("target", half_up(F.col("total")).alias("population"), "n_sources", kind.alias("conversion"))


def provenance(links: DataFrame) -> DataFrame:
    """(target, n_sources, sources): the sources, sorted, of each target that gets people; a target has few sources."""
    known = links.where("population is not null and fraction is not null")
    out = known.groupBy("target").agg(F.sum(F.col("population") * F.col("fraction")).alias("total"), F.count("*").alias("n_sources"), F.array_sort(F.collect_list("source")).alias("sources"))
    return out.where("total > 0").drop("total")


def conservation(links: DataFrame) -> DataFrame:
    """Per cent of all sources' population that arrives at targets (one row)."""
    known = links.where("population is not null and fraction is not null")
    by_source = known.groupBy("source").agg(F.min("population").alias("p"), F.sum(F.col("population") * F.col("fraction")).alias("moved"))
    return by_source.agg((F.try_divide(F.sum("moved"), F.sum("p")) * 100).alias("conserved_percent"))
