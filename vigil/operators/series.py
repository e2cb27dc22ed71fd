"""Series over ordered labels: lags, fills, buckets, windows as samples, correlation over lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.shared import numbered


def _order(label: str, partition: list[str] | None):
    return Window.partitionBy(*(partition or [])).orderBy(label)


def lags(df: DataFrame, value: str, n: int, label: str = "label", partition: list[str] | None = None) -> DataFrame:
    w = _order(label, partition)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"lag{k}") for k in range(1, n + 1)])


def next_value(df: DataFrame, value: str, label: str = "label", partition: list[str] | None = None, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.lead(value).over(_order(label, partition)))


def expanding_zero_share(df: DataFrame, value: str, label: str, partition: list[str]) -> DataFrame:
    """Share of zeros among the rows before; null for the first."""
    w = _order(label, partition).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("zero_share", F.try_divide(F.sum((F.col(value) == 0).cast("double")).over(w), F.count(value).over(w)))


def fill(df: DataFrame, value: str, label: str = "label", partition: list[str] | None = None) -> DataFrame:
    """``ffill``: last value so far; ``bfill``: next value; ``linear``: between them, the last one carried on at the end."""
    w = _order(label, partition)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    df = df.withColumn("_p", pos).withColumn("_k", F.when(F.col(value).isNotNull(), F.col("_p")))
    low, high = F.last("_k", ignorenulls=True).over(back), F.first("_k", ignorenulls=True).over(ahead)
    df = df.withColumn("ffill", F.last(value, ignorenulls=True).over(back)).withColumn("bfill", F.first(value, ignorenulls=True).over(ahead)).withColumn("_l", low).withColumn("_h", high)
    between = F.col("ffill") + (F.col("bfill") - F.col("ffill")) * F.try_divide(F.col("_p") - F.col("_l"), F.col("_h") - F.col("_l"))
    linear = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("ffill").isNull(), None).when(F.col("bfill").isNull(), F.col("ffill")).otherwise(between)
    return df.withColumn("linear", linear).drop("_p", "_k", "_l", "_h")


def group_series(df: DataFrame, value: str, size: int, offset: int = 0, label: str = "label", operation: str = "sum") -> DataFrame:
    """Buckets of ``size`` positions; the first ``offset`` rows are a bucket of their own. A bucket's label is its first."""
    pick = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "min": F.min, "max": F.max}
    if operation not in pick:
        raise ValueError(f"unknown operation {operation!r}; there are {sorted(pick)}")
    b = numbered(df, label, name="_i").withColumn("bucket", F.floor((F.col("_i") - offset) / size).cast("int"))
    return b.groupBy("bucket").agg(F.min(label).alias(label), pick[operation](F.col(value)).alias(value))


def sample_windows(df: DataFrame, value: str, length: int, label: str = "label", partition: list[str] | None = None) -> DataFrame:
    """Each run of ``length`` rows without a null as an array, under its last label."""
    w = _order(label, partition).rowsBetween(1 - length, 0)
    return df.withColumn("window", F.collect_list(value).over(w)).where(F.size("window") == length)


def peak(df: DataFrame, value: str, label: str, partition: list[str]) -> DataFrame:
    """Rows from each series' peak (the first on ties) and value / peak value."""
    w = Window.partitionBy(*partition)
    df = df.withColumn("_i", F.row_number().over(_order(label, partition)))
    df = df.withColumn("_top", F.min(F.struct((-F.col(value)).alias("v"), F.col("_i").alias("i"))).over(w))
    return df.withColumn("from_peak", F.col("_i") - F.col("_top.i")).withColumn("of_peak", F.try_divide(F.col(value), -F.col("_top.v"))).drop("_i", "_top")


def normalise(df: DataFrame, value: str, method: str = "zscore", partition: list[str] | None = None) -> DataFrame:
    """zscore (sample deviation), minmax or l2 over each partition; null where the spread is 0."""
    v = F.col(value).cast("double")
    measures = {"_m": F.avg(v), "_s": F.stddev_samp(v), "_a": F.min(v), "_b": F.max(v), "_q": F.sum(v * v)}
    ways: dict[str, Column] = {
        "zscore": F.try_divide(v - F.col("_m"), F.col("_s")),
        "minmax": F.try_divide(v - F.col("_a"), F.col("_b") - F.col("_a")),
        "l2": F.try_divide(v, F.sqrt("_q")),
    }
    if method not in ways:
        raise ValueError(f"unknown method {method!r}; there are {sorted(ways)}")
    if partition:
        w = Window.partitionBy(*partition)
        rows = df.withColumns({k: m.over(w) for k, m in measures.items()})
    else:  # one row of measures, not a window over everything
        rows = df.crossJoin(F.broadcast(df.agg(*[m.alias(k) for k, m in measures.items()])))
    return rows.withColumn(method, ways[method]).drop(*measures)


def correlation(x: str, y: str) -> Column:
    """Pearson over complete pairs; null for fewer than two or without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def lagged_correlation(df: DataFrame, x: str, y: str, max_lag: int, label: str = "label", window: int | None = None, partition: list[str] | None = None) -> DataFrame:
    """(lag, corr, n) for lags -max_lag..max_lag, all in one job: lag > 0 pairs x[t + lag] with y[t], so y leads.

    Both series are cut to the positions before the earlier of their last values, at most ``window`` of them.
    """
    keys = partition or []
    p = df.withColumn("_p", F.row_number().over(_order(label, keys)) - 1)
    ends = p.groupBy(*keys).agg(F.least(F.max(F.when(F.col(x).isNotNull(), F.col("_p"))), F.max(F.when(F.col(y).isNotNull(), F.col("_p")))).alias("_last"))
    p = p.join(F.broadcast(ends), keys) if keys else p.crossJoin(F.broadcast(ends))
    size = F.least(F.lit(window), F.col("_last")) if window else F.col("_last")
    p = p.where((F.col("_p") < F.col("_last")) & (F.col("_p") >= F.col("_last") - size))
    left = p.select(*keys, F.col("_p").alias("_a"), F.col(x).alias("_x"))
    right = p.select(*keys, F.col("_p"), F.col(y).alias("_y"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("_a", F.col("_p") + F.col("lag"))
    pairs = left.join(right, [*keys, "_a"])
    return pairs.groupBy(*keys, "lag").agg(correlation("_x", "_y").alias("corr"), F.sum((F.col("_x").isNotNull() & F.col("_y").isNotNull()).cast("int")).cast("bigint").alias("n"))


def best_lag(corr: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """The lag of the largest absolute correlation, the smaller lag on ties, with its sign."""
    pick = F.min(F.struct((-F.abs("corr")).alias("a"), F.col("lag").alias("lag"), F.col("corr").alias("corr"))).alias("b")
    rows = corr.where("corr is not null")
    return (rows.groupBy(*partition) if partition else rows.groupBy()).agg(pick).where("b is not null").select(*(partition or []), "b.lag", "b.corr")


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats over equal-width bins (one row); a stand-in for estimators by neighbours."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    e = d.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))])

    def cell(c):
        return F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"a{c}")) * bins, F.col(f"b{c}") - F.col(f"a{c}")), F.lit(0.0))), F.lit(bins - 1)).cast("int")

    joint = d.crossJoin(F.broadcast(e)).groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"))
    t = joint.withColumn("ni", F.sum("n").over(Window.partitionBy("i"))).withColumn("nj", F.sum("n").over(Window.partitionBy("j"))).withColumn("t", F.sum("n").over(Window.partitionBy()))
    return t.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mutual_information"))


def rolling_forecast(df: DataFrame, value: str, alpha: float, label: str = "label", partition: list[str] | None = None) -> DataFrame:
    """(partition, label, value, forecast): each value's forecast from those before it, by a level that every value updates.

    The level is the first value at first, then ``alpha`` times the value plus the rest of the level. A null value leaves it. A series is
    gathered in one row, so it is one a partition of moderate length.
    """
    keys = partition or []
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).cast("double").alias("v")))).alias("s"))
    empty = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast("array<double>").alias("out"))

    def step(state, x):
        level = F.when(x["v"].isNull(), state["level"]).when(state["level"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * state["level"])
        return F.struct(level.alias("level"), F.concat(state["out"], F.array(state["level"])).alias("out"))

    told = g.select(*keys, F.arrays_zip(F.col("s"), F.aggregate("s", empty, step)["out"].alias("f")).alias("z"))
    return told.select(*keys, F.explode("z").alias("z")).select(*keys, F.col("z.s.l").alias(label), F.col("z.s.v").alias(value), F.col("z.f").alias("forecast"))


def shifted(df: DataFrame, x: str, y: str, lag: int, label: str = "label") -> DataFrame:
    """(label, x, y) with y of ``lag`` rows before, for the rows that have both."""
    rows = numbered(df.select(label, x, y), label, name="_i")
    before = rows.select((F.col("_i") + lag).alias("_i"), F.col(y).alias("_y"))
    return rows.join(before, "_i").select(label, x, F.col("_y").alias(y)).dropna()
