"""Exposure intervals: overlaps, daily spread, gaps, date labels and date repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.shared import cut


def overlaps(df: DataFrame, entity: str = "trap", start: str = "dt_instal", end: str = "dt_col", key: str = "sample") -> DataFrame:
    """Pairs of samples of one entity where a sample's end reaches the next start (the same day counts)."""
    w = Window.partitionBy(entity).orderBy(start, end, key)
    out = df.select(entity, F.col(key).alias("first"), F.lead(key).over(w).alias("second"), F.col(end).alias("_e"), F.lead(start).over(w).alias("_s"))
    return out.where(F.col("_e") >= F.col("_s")).select(entity, "first", "second")


BLOCK = 16  # days that one row of sums holds


def _positive(df: DataFrame, start: str, end: str) -> DataFrame:
    """Exposures of at least a day, with their first day and the day after their last as numbers."""
    rows = df.withColumns({"_from": F.unix_date(F.col(start).cast("date")), "_to": F.unix_date(F.col(end).cast("date"))})
    return rows.where(F.col("_to") > F.col("_from"))


def _parts(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """A row for each exposure and block of days that it meets: its days there [_a, _b) and its value a day."""
    block = lambda c: F.floor(c / BLOCK).cast("int")
    parts = rows.select(entity, "_from", "_to", (F.col(value) / (F.col("_to") - F.col("_from"))).alias("_v"), F.explode(F.sequence(block(F.col("_from")), block(F.col("_to") - 1))).alias("_block"))
    first = F.col("_block") * BLOCK
    return parts.select(entity, "_block", F.greatest(F.col("_from") - first, F.lit(0)).cast("byte").alias("_a"), F.least(F.col("_to") - first, F.lit(BLOCK)).cast("byte").alias("_b"), "_v")


def _days(parts: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, day, value, exposed) for every day of the blocks that ``parts`` names.

    Parts are dealt by entity and block before they are added up, a sum a day of the block, so no row a day is shuffled or grouped.
    """
    sums = [F.sum(F.when((F.col("_a") <= i) & (F.col("_b") > i), F.col("_v"))).alias(f"_{i}") for i in range(BLOCK)]
    met = F.bit_or(F.expr("shiftleft(1, _b) - shiftleft(1, _a)")).alias("_met")
    blocks = parts.repartition(entity, "_block").groupBy(entity, "_block").agg(*sums, met)
    days = blocks.select(entity, "_block", "_met", F.posexplode(F.array(*[f"_{i}" for i in range(BLOCK)])).alias("_i", value))
    return days.select(entity, F.date_from_unix_date(F.col("_block") * BLOCK + F.col("_i")).alias("day"), value, (F.expr("shiftright(_met, _i)").bitwiseAND(F.lit(1)) == 1).alias("_exposed"))


def daily_spread(df: DataFrame, entity: str = "trap", start: str = "dt_instal", end: str = "dt_col", value: str = "eggs") -> DataFrame:
    """value / days on every day from start to the day before end, summed where exposures overlap.

    Exposures of no or negative length give no day.
    """
    return _days(_parts(_positive(df, start, end), entity, value), entity, value).where("_exposed").drop("_exposed")


def dense_daily_spread(df: DataFrame, entity: str = "trap", start: str = "dt_instal", end: str = "dt_col", value: str = "eggs") -> DataFrame:
    """``daily_spread`` on every day between the first and the last of all entities; days on which an entity was not exposed are null.

    Each entity is added to every block of days without a value, so no join with the days is needed. An entity that is null is
    known on no day.
    """
    rows = _positive(df, start, end)
    entities = cut(rows.groupBy(entity).agg(F.min("_from").alias("_first"), F.max("_to").alias("_last")), "entities")
    span = entities.agg(F.min("_first").alias("_first"), (F.max("_last") - 1).alias("_last")).where("_first is not null")
    spine = span.select(F.explode(F.sequence(F.floor(F.col("_first") / BLOCK).cast("int"), F.floor(F.col("_last") / BLOCK).cast("int"))).alias("_block"))  # a row a block
    parts = _parts(rows, entity, value)
    none = entities.select(entity).crossJoin(F.broadcast(spine)).select(entity, "_block", F.lit(0).cast("byte").alias("_a"), F.lit(0).cast("byte").alias("_b"), F.lit(None).cast(parts.schema["_v"].dataType).alias("_v"))
    days = _days(parts.unionByName(none), entity, value).crossJoin(F.broadcast(span))
    inside = F.unix_date("day").between(F.col("_first"), F.col("_last"))
    return days.where(inside).select(entity, "day", F.when(F.col(entity).isNotNull(), F.col(value)).alias(value))


def dense_days(df: DataFrame, day: str = "day", fill: float | None = None, value: str = "n") -> DataFrame:
    """All days between the first and the last; absent ones get ``fill``. One row a day goes in."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "b")).alias(day))
    out = spine.join(df, day, "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def gaps(df: DataFrame, entity: str = "trap", date: str = "dt_col") -> DataFrame:
    """Days since the entity's sample before."""
    w = Window.partitionBy(entity).orderBy(date)
    return df.select(entity, date, F.datediff(date, F.lag(date).over(w)).alias("gap_days"))


def label_dates(df: DataFrame, ranges: DataFrame, date: str = "dt") -> DataFrame:
    """Each row with every label whose days [start, end] hold its date, by an equi-join on the day.

    Ranges are spread over their days, so no nested loop is planned; rows in no range are left out.
    """
    days = ranges.where("start <= end").select("label", F.explode(F.sequence("start", "end")).alias(date))
    return df.join(days, date)


def repair_dates(df: DataFrame) -> DataFrame:
    """Repairs dt_col of (sample, trap, dt_instal, dt_col, novos) in a fixed order and derives exposure.

    1. equal dates, 2. dates in the wrong order, 3. a missing dt_col: seven days after dt_instal. 4. a sample that
    reaches its trap's next one likewise (once, judged before this step). 5. rows without ``novos`` go. 6. exposures
    over 21 or under 4 days, judged before this step, likewise. Last, days_expo and eggs_per_day.
    """
    week = F.date_add("dt_instal", 7)
    df = df.withColumn("dt_col", F.when(F.col("dt_col") == F.col("dt_instal"), week).otherwise(F.col("dt_col")))
    df = df.withColumn("dt_col", F.when(F.col("dt_instal") > F.col("dt_col"), week).otherwise(F.coalesce("dt_col", week)))
    w = Window.partitionBy("trap").orderBy("dt_instal", "dt_col", "sample")
    df = df.withColumn("_next", F.lead("dt_instal").over(w))
    df = df.withColumn("dt_col", F.when(F.col("dt_col") >= F.col("_next"), week).otherwise(F.col("dt_col"))).drop("_next")
    df = df.where("novos is not null")
    days = F.datediff("dt_col", "dt_instal")
    df = df.withColumn("dt_col", F.when((days > 21) | (days < 4), week).otherwise(F.col("dt_col")))
    df = df.withColumn("days_expo", days.cast("int"))
    return df.withColumn("eggs_per_day", F.try_divide(F.col("novos").cast("double"), F.col("days_expo")))


def patch(df: DataFrame, patches: DataFrame, keys: list[str], column: str, order: str | None = None) -> DataFrame:
    """Replaces ``column`` by ``patches.new_value`` where keys match. ``unmatched_patches`` finds the others.

    No row is doubled: of several patches of a key the last by ``order`` counts (by the value on ties); without an order the run fails if
    they differ. Null values patch nothing.
    """
    some = patches.where("new_value is not null").groupBy(*keys)
    if order is None:
        unclear = F.raise_error(F.concat(F.lit("patches differ for one key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
        one = some.agg(F.min("new_value").alias("_low"), F.max("new_value").alias("_new"))
        one = one.select(*keys, F.when(F.col("_low") == F.col("_new"), F.col("_new")).otherwise(unclear.cast(one.schema["_new"].dataType)).alias("_new"))
    else:
        one = some.agg(F.max(F.struct(F.col(order), F.col("new_value"))).alias("_last")).select(*keys, F.col("_last.new_value").alias("_new"))
    return df.join(one, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def unmatched_patches(df: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    return patches.join(df, keys, "left_anti")
