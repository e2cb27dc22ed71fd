"""Profiles, checks and comparison of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null, nulls, null_percent) from a single aggregation."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).cast("bigint").alias("non_null")) for c, t in df.dtypes]))
    out = counts.select(F.col("_n").cast("bigint").alias("_n"), rows.alias("r"))
    nulls = F.col("_n") - F.col("r.non_null")
    return out.select("r.column", "r.type", "r.non_null", nulls.alias("nulls"), F.try_divide(nulls * 100.0, F.col("_n")).alias("null_percent"))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one value, where null counts as a value."""
    row = df.agg(*[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 1]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def distinct_values(df: DataFrame) -> DataFrame:
    """(column, n_distinct) of all columns in one pass."""
    row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in df.columns])).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each key (of whole rows by default)."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows where a rule is false or null, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("bigint").alias("violations")) for k in rules])).alias("r")).select("r.*")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct keys that have no parent."""
    p = parents.select(F.col(parent_key or key).alias(key))
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(p, key, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def changed_cells(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, old, new) of cells that differ as text; nulls are equal to each other."""
    j = old.select(*keys, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns]).join(new.select(*keys, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns]), keys)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in columns])).alias("x")
    return j.select(*keys, cells).select(*keys, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def any_of(*conditions: Column | None) -> Column:
    """OR of the conditions that are given; true if none is."""
    some = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, some) if some else F.lit(True)


def threshold_mask(rate: Column, low: float | None = None, high: float | None = None, *checks: Column) -> Column:
    """Rows under ``low`` (a null rate counts as 0), over ``high``, or that meet a check."""
    return any_of(None if low is None else F.coalesce(rate, F.lit(0.0)) >= low, None if high is None else rate <= high, *checks)


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are, in that order."""
    return df.select([c for c in wanted if c in df.columns])


def columns_like(df: DataFrame, *prefixes: str) -> dict[str, list[str]]:
    """Columns by the prefix of their names."""
    return {p: [c for c in df.columns if c.startswith(p)] for p in prefixes}


def valid_samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of the columns without a null."""
    return df.select(*columns).dropna().distinct()


def rows_with_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where a column has a value; rows that are null throughout are never among them, even for a null value."""
    return df.where(F.col(column).eqNullSafe(value)).dropna(how="all")


def rows_with_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def type_census(df: DataFrame) -> DataFrame:
    """(column, kind, n): how many values of each column read as null, whole number, number or text, in one pass."""
    kinds = ("null", "whole", "number", "text")

    def kind(c):
        t = F.col(c).cast("string")
        return F.when(t.isNull(), "null").when(t.rlike("^[+-]?[0-9]+$"), "whole").when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "number").otherwise("text")

    counts = df.agg(*[F.count_if(kind(c) == k).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"{i}_{k}").alias("n")) for i, c in enumerate(df.columns) for k in kinds])
    return counts.select(F.inline(cells)).where("n > 0")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of every value of the columns, as text; null is a value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))


def pivot_unique(df: DataFrame, keys: list[str], column: str, levels: list, value: str) -> DataFrame:
    """One row a key, one column a level; raises if a key and level have more than one row."""
    twice = df.groupBy(*keys, column).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{keys} and {column} have more than one row, such as {twice.first()}")
    return df.groupBy(*keys).pivot(column, levels).agg(F.first(value))


def checked_patch(df: DataFrame, patches: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``intervals.patch`` that raises where a patch has no row to change."""
    from vigil.operators.intervals import patch, unmatched_patches

    lost = unmatched_patches(df, patches, keys)
    if not lost.isEmpty():
        raise ValueError(f"no row for the patch {lost.first()}")
    return patch(df, patches, keys, column)


def require(df: DataFrame, columns: dict[str, str], not_negative: tuple[str, ...] = ()) -> DataFrame:
    """The table itself; raises if it is empty, lacks a column, has one of another type, or a negative value where none may be."""
    types = dict(df.dtypes)
    if missing := [c for c in columns if c not in types]:
        raise ValueError(f"columns are missing: {missing}")
    if wrong := {c: types[c] for c, t in columns.items() if t and types[c] != t}:
        raise TypeError(f"columns have other types than wanted: {wrong}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    if not_negative and not df.where(any_of(*[F.col(c) < 0 for c in not_negative])).isEmpty():
        raise ValueError(f"negative values in {list(not_negative)}")
    return df


def finite_numbers(values) -> list[float]:
    """The values as floats; raises for text, truth values, NaN and infinities."""
    import math

    out = []
    for v in values:
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError(f"{v!r} is not a number")
        if not math.isfinite(v):
            raise ValueError(f"{v!r} is not finite")
        out.append(float(v))
    return out
