"""Number and text expressions with defined results at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(x: Column, places: int = 6) -> Column:
    """Half-up on the binary value: equal in all engines, unlike decimal rounding."""
    unit = float(10**places)
    return F.floor(x * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def per_thousand(events: Column, population: Column) -> Column:
    """0 where the population is 0 or null."""
    return F.when(population > 0, events / population * 1000.0).otherwise(F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Nulls stay null (least and greatest alone would skip them)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def right_closed_bins(x: Column, edges: Sequence[float]) -> Column:
    """0 for x <= edges[0], 1 up to edges[1] and so on; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(edges):
        out = out.when(x <= e, i)
    return out.otherwise(len(edges))


def left_closed_bins(x: Column, width: float, last: int) -> Column:
    return F.when(x.isNotNull(), F.least(F.floor(x / width), F.lit(last)).cast("int"))


def season(week: Column, weeks: Column) -> Column:
    """|sin(pi (week - 30) / weeks)|."""
    return F.abs(F.sin(F.pi() * (week - 30) / weeks))


def above(x: Column, limit: float, below: int = 0) -> Column:
    return F.when(x > limit, 1).otherwise(below)


def comma_decimal(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def id_text(x: Column) -> Column:
    """Text of an id that may have been read as a float."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def last_two(number: Column) -> Column:
    return F.right(number.cast("bigint").cast("string"), F.lit(2)).cast("int")


def null_if(x: Column, *sentinels: float) -> Column:
    return F.when(~x.isin(*sentinels), x)


def finite_or_zero(num: Column, den: Column) -> Column:
    """num / den; 0 where that is null, not a number or infinite."""
    ratio = F.try_divide(num, den)
    return F.when(ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf")), F.lit(0.0)).otherwise(ratio)


def prefixed_id(x: Column, prefix: str = "90") -> Column:
    return F.concat(F.lit(prefix), x.cast("string")).cast("bigint")


def label_lookup(code: Column, names: dict, default: str = "") -> Column:
    table = F.create_map(*[v for k, name in names.items() for v in (F.lit(k), F.lit(name))])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def split_pair(text: Column, sep: str = ",") -> tuple[Column, Column]:
    """Two numbers in one text."""
    return tuple(F.trim(F.split_part(text, F.lit(sep), F.lit(i))).try_cast("double") for i in (1, 2))


def row_mean(*cols: Column) -> Column:
    """Mean of the columns that are not null; null if all are."""
    values = F.array_compact(F.array(*cols))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def row_sum(*cols: Column) -> Column:
    return F.aggregate(F.array_compact(F.array(*cols)), F.lit(0.0), lambda a, x: a + x)


def row_median(*cols: Column) -> Column:
    v = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(v)
    low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def unprefixed_id(x: Column, prefix: str = "90") -> Column:
    """The number behind the prefix of ``prefixed_id``."""
    text = x.cast("string")
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 40)).otherwise(text).cast("bigint")


def replace_names(text: Column, names: dict[str, str]) -> Column:
    """Patterns replaced one after the other, wherever they match."""
    for pattern, name in names.items():
        text = F.regexp_replace(text, pattern, name)
    return text


def whole_id_text(x: Column) -> Column:
    """An id by way of a whole number, exact to 32 digits: ``12.0``, ``12`` and ``1.2E1`` give ``12``; parts of one are cut off, other texts give null."""
    whole = F.regexp_replace(x.try_cast("decimal(38, 6)").cast("string"), r"\..*$", "")
    return F.when(whole == "-0", "0").otherwise(whole)
