"""The epidemic calendar and other dates as column expressions.

An epidemic year starts on the Sunday on or before 1 June; its weeks start on Sundays and count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def year_start(year: Column) -> Column:
    june = F.make_date(year, F.lit(6), F.lit(1))
    return F.date_sub(june, F.dayofweek(june) - 1)


def epidemic_year(date: Column) -> Column:
    y = F.year(date)
    return F.when(date >= year_start(y), y).otherwise(y - 1)


def epidemic_week(date: Column) -> Column:
    return (F.floor(F.datediff(date, year_start(epidemic_year(date))) / 7) + 1).cast("int")


def pad2(number: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def year_label(year: Column) -> Column:
    """``YYYY_YY``."""
    return F.concat(year.cast("string"), F.lit("_"), pad2((year + 1) % 100))


def week_label(date: Column) -> Column:
    """``YYYY_YYWww``."""
    return F.concat(year_label(epidemic_year(date)), F.lit("W"), pad2(epidemic_week(date)))


def label_of(year_text: Column, week: Column) -> Column:
    return F.concat(year_text, F.lit("W"), pad2(week))


def biweek_of_week(week: Column) -> Column:
    return (F.floor((week + 1) / 2) * 2).cast("int")


def biweek_label(date: Column) -> Column:
    return F.concat(year_label(epidemic_year(date)), F.lit("W"), pad2(biweek_of_week(epidemic_week(date))))


def biweek_of_label(label: Column) -> Column:
    """The biweek label of a week label."""
    return F.concat(F.split_part(label, F.lit("W"), F.lit(1)), F.lit("W"), pad2(biweek_of_week(F.split_part(label, F.lit("W"), F.lit(2)).cast("int"))))


def ordinal_of_label(label: Column) -> Column:
    """start year * 53 + week - 1; years of 52 weeks leave a gap."""
    return F.substring(label, 1, 4).cast("int") * 53 + F.split_part(label, F.lit("W"), F.lit(2)).cast("int") - 1


def is_label(label: Column) -> Column:
    """Form ``YYYY_YYWww``, second year after the first, week 1 to 53."""
    form = label.rlike(r"^\d{4}_\d{2}W\d{2}$")
    week = F.try_to_number(F.substring(label, 9, 2), F.lit("99")).cast("int")
    years = (F.try_to_number(F.substring(label, 1, 4), F.lit("9999")).cast("int") + 1) % 100 == F.try_to_number(F.substring(label, 6, 2), F.lit("99")).cast("int")
    return F.coalesce(form & years & week.between(1, 53), F.lit(False))


def same_week_as_june1(date: Column) -> Column:
    start = year_start(F.year(date))
    return (date >= start) & (date <= F.date_add(start, 6))


def iso_label_to_date(label: Column) -> Column:
    """Monday of ``YYYY-Www``: the week that holds 4 January is the first."""
    jan4 = F.make_date(F.split_part(label, F.lit("-W"), F.lit(1)).cast("int"), F.lit(1), F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    return F.date_add(monday, (F.split_part(label, F.lit("-W"), F.lit(2)).cast("int") - 1) * 7)


def compact_iso_label(label: Column) -> Column:
    """``2020W5`` to ``202005``; what stands before W is kept as it is."""
    return F.concat(F.split_part(label, F.lit("W"), F.lit(1)), pad2(F.split_part(label, F.lit("W"), F.lit(2)).cast("int")))


def ordinal_day(date: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.unix_date(date) + 719163


def parse_date(text: Column, *formats: str) -> Column:
    """First format that fits, without time; null where none does."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def epoch_millis_text(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def hour_text(hour: Column) -> Column:
    """``0`` to ``00:00``, ``930`` to ``09:30``."""
    four = F.lpad(hour.cast("string"), 4, "0")
    return F.concat(F.substring(four, 1, 2), F.lit(":"), F.substring(four, 3, 2))


def week_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All week labels from the label ``first`` to ``last``, both included, with their first day."""
    start, end = (int(x[:4]) for x in (first, last))
    years = spark.range(start, end + 1).select(F.col("id").cast("int").alias("y"))
    days = years.select("y", F.explode(F.sequence(year_start(F.col("y")), F.date_sub(year_start(F.col("y") + 1), 7), F.expr("interval 7 days"))).alias("week_start"))
    return days.select(week_label(F.col("week_start")).alias("epidemic_date"), "week_start").where(F.col("epidemic_date").between(first, last))


def week_days(spark: SparkSession, year: int) -> DataFrame:
    """The 53 or 52 weeks of an epidemic year with the seven days of each."""
    weeks = spark.range(1).select(F.explode(F.sequence(year_start(F.lit(year)), F.date_sub(year_start(F.lit(year + 1)), 7), F.expr("interval 7 days"))).alias("d"))
    return weeks.select(epidemic_week(F.col("d")).alias("week"), F.explode(F.sequence("d", F.date_add("d", 6))).alias("day"))


def day_and_hour(day: Column, hour: Column) -> Column:
    """Time of a day (``yyyy-MM-dd`` or ``yyyy/MM/dd``) and an hour as ``0``, ``930``, ``0930`` or ``09:30 UTC``; null if neither layout fits."""
    text = F.trim(F.regexp_replace(hour.cast("string"), "UTC", ""))
    clock = F.when(text.contains(":"), text).otherwise(hour_text(text))
    both = F.concat_ws(" ", F.regexp_replace(day, "/", "-"), clock)
    return F.try_to_timestamp(both, F.lit("yyyy-MM-dd HH:mm"))
