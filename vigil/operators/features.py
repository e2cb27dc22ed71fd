"""Feature tables: neighbours by lags, scaling, encodings, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.shared import cut, drop_cut, numbered


def neighbour_lag_matrix(samples: DataFrame, spine: DataFrame, neighbours: DataFrame, n_lags: int, n_neighbours: int) -> DataFrame:
    """Lagged values of each sample's nearest eligible neighbours, itself first.

    ``samples``: trap, week (int ordinal), day, value. ``spine``: week. ``neighbours``: trap, other, rank (0: itself). Each trap's
    last ``2 * n_lags`` weeks before the sample's week are gathered on the dense spine; a neighbour is eligible if at least
    ``n_lags`` of them have a value, and gives its latest ``n_lags``. Samples with fewer than ``n_neighbours`` eligible neighbours are
    left out. Result: trap, week, value, features: array (neighbour order) of struct(other, values, days).
    """
    span = 2 * n_lags
    traps = samples.select("trap").distinct()
    weeks = spine.select("week").distinct().withColumn("_w", F.row_number().over(Window.orderBy("week")))  # a row a week
    dense = traps.crossJoin(F.broadcast(weeks)).join(samples.select("trap", "week", "day", "value"), ["trap", "week"], "left")
    w = Window.partitionBy("trap").orderBy("week").rowsBetween(-span, -1)
    seen = dense.withColumn("h", F.collect_list(F.when(F.col("value").isNotNull(), F.struct("week", "value", "day"))).over(w))
    seen = cut(seen.select("trap", "week", "_w", (F.size("h") >= n_lags).alias("ok"), F.when(F.size("h") >= n_lags, F.slice(F.reverse("h"), 1, n_lags)).alias("h")), "lags")
    # Who is eligible in which week is a flag for each week of the spine: samples choose by flags, and only the chosen meet their lags.
    flags = seen.groupBy(F.col("trap").alias("other")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "ok"))), lambda x: x["ok"]).alias("ok"))
    near = neighbours.select("trap", "other", "rank").join(flags, "other").groupBy("trap").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "ok"))).alias("near"))
    own = samples.where("value is not null").select("trap", "week", F.col("day").alias("_day"), "value").join(F.broadcast(weeks), "week")
    able = F.transform(F.filter("near", lambda x: F.get(x["ok"], F.col("_w") - 1)), lambda x: x["other"])
    picked = own.join(near, "trap").withColumn("able", F.slice(able, 1, n_neighbours)).where(F.size("able") == n_neighbours)
    picked = picked.select("trap", "week", "_day", "value", F.posexplode("able").alias("r", "other"))
    lags = seen.where("ok").select(F.col("trap").alias("other"), "week", "h")
    met = picked.join(lags, ["other", "week"])
    item = F.struct((F.col("r") + 1).alias("r"), "other", F.transform("h", lambda x: x["value"]).alias("values"), F.transform("h", lambda x: F.datediff(F.col("_day"), x["day"])).alias("days"))
    return met.groupBy("trap", "week").agg(F.first("value").alias("value"), F.array_sort(F.collect_list(item)).alias("features"))


def max_abs_scale(df: DataFrame, groups: dict[str, list[str]], train: Column) -> DataFrame:
    """Divides each group of columns by the group's largest absolute value in the training rows (one-row broadcast)."""
    top = df.where(train).agg(*[F.greatest(*[F.max(F.abs(F.col(c))) for c in cs], F.lit(0.0)).alias(f"_m_{g}") for g, cs in groups.items()])
    out = df.crossJoin(F.broadcast(top))
    for g, cs in groups.items():
        for c in cs:
            out = out.withColumn(c, F.try_divide(F.col(c).cast("double"), F.col(f"_m_{g}")))
    return out.drop(*[f"_m_{g}" for g in groups])


def standard_scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - mean) / population deviation, both from the training rows."""
    stats = df.where(train).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*stats.columns)


def one_hot(df: DataFrame, column: str, levels: list, drop_first: bool = True) -> DataFrame:
    """0/1 columns of the sorted levels, without the first."""
    use = sorted(levels)[1 if drop_first else 0 :]
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in use])


def codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Codes 0.. of the sorted values, through a join with the distinct values."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = levels.withColumn(name, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(ranked, column, "left")


def chronological_split(df: DataFrame, label: str, ratio: float) -> DataFrame:
    """``split``: train for the first int(n * ratio) rows by label, else test. Rows are numbered over ranges of the label, not in one task."""
    rows = numbered(df, label, name="_i")
    return rows.withColumn("split", F.when(F.col("_i") < int(rows.count() * ratio), "train").otherwise("test")).drop("_i")


def hash_split(df: DataFrame, key: str, test_percent: int, salt: str = "split") -> DataFrame:
    """Repeatable random split by the first byte of a hash of the key, which every engine computes alike."""
    cut = f"{round(256 * test_percent / 100):02x}"
    first = F.substring(F.md5(F.concat(F.lit(f"{salt}/"), F.col(key).cast("string"))), 1, 2)
    return df.withColumn("split", F.when(first < cut, "test").otherwise("train"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """rmse, mae, r2 and mape (per cent, 1e-8 added to the truth) over complete rows."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    d = df.where(y.isNotNull() & p.isNotNull())
    sse, sst = F.sum((y - p) * (y - p)), F.sum(y * y) - F.sum(y) * F.avg(y)
    return d.groupBy(*by).agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.try_divide(sse, sst)).alias("r2"), (F.avg(F.abs((y - p) / (y + 1e-8))) * 100).alias("mape")
    )


def linear_fit(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """slope, intercept, r2 and n of the least squares line."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.where(a.isNotNull() & b.isNotNull())
    cov, vx, vy = F.covar_pop(a, b), F.var_pop(a), F.var_pop(b)
    slope = F.try_divide(cov, F.nullif(vx, F.lit(0.0)))
    return d.groupBy(*by).agg(slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), F.try_divide(cov * cov, F.nullif(vx * vy, F.lit(0.0))).alias("r2"), F.count("*").alias("n"))


def permutation_importance(df: DataFrame, model, features: list[str], truth: str, predicted: str = "prediction", repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance): mean rise of the squared error when a feature's values are dealt anew by a hash order."""
    spark = df.sparkSession
    base = model.transform(df).agg(F.avg(F.pow(F.col(truth) - F.col(predicted), 2)).alias("e")).first()["e"]
    rows = []
    rows_ = numbered(df, F.xxhash64(*df.columns), name="_i")
    for f in features:
        rise = []
        for k in range(repeats):
            dealt = numbered(rows_.select(F.col("_i").alias("_j"), f), F.xxhash64("_j", F.lit(seed + k)), name="_i")
            moved = rows_.drop(f).join(dealt.drop("_j"), "_i")
            rise.append(model.transform(moved).agg(F.avg(F.pow(F.col(truth) - F.col(predicted), 2)).alias("e")).first()["e"] - base)
            drop_cut(dealt)
        rows.append((f, float(sum(rise) / len(rise))))
    drop_cut(rows_)
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def stepwise(df: DataFrame, candidates: list[str], label: str, direction: str = "both") -> list[str]:
    """Features of a logistic regression, added (``forward``), dropped (``backward``) or either, one at a time while the AIC falls.

    A driver loop over models; each fit is distributed.
    """
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    known: dict[frozenset, float] = {}

    def aic(features) -> float:
        key = frozenset(features)
        if key not in known:
            use = sorted(features)
            d = df.withColumn("_y", F.col(label).cast("double")).withColumn("_one", F.lit(0.0))  # a constant feature stands for none
            d = VectorAssembler(inputCols=use or ["_one"], outputCol="_f", handleInvalid="skip").transform(d)
            m = LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=50).fit(d)
            p = F.get(vector_to_array("probability"), F.col("_y").cast("int"))
            ll = m.transform(d).agg(F.sum(F.ln(F.greatest(p, F.lit(1e-300)))).alias("l")).first()["l"]
            known[key] = 2 * (len(use) + 1) - 2 * (ll if ll is not None else -math.inf)
        return known[key]

    chosen = list(candidates) if direction == "backward" else []
    best = aic(chosen)
    while True:
        moves = []
        if direction != "backward":
            moves += [[*chosen, c] for c in candidates if c not in chosen]
        if direction != "forward":
            moves += [[x for x in chosen if x != c] for c in chosen]
        if not moves:
            return chosen
        score, at = min((aic(m), i) for i, m in enumerate(moves))
        if score >= best:
            return chosen
        chosen, best = moves[at], score


def forward_stepwise(df: DataFrame, candidates: list[str], label: str) -> list[str]:
    return stepwise(df, candidates, label, "forward")


def tree_model(df: DataFrame, features: list[str], label: str, kind: str = "regressor", boosted: bool = False, seed: int = 42):
    """A fitted pipeline of an assembler and a forest or boosted trees, as regressor or classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r
    from pyspark.ml.feature import VectorAssembler

    makers = {("regressor", False): r.RandomForestRegressor, ("regressor", True): r.GBTRegressor, ("classifier", False): c.RandomForestClassifier, ("classifier", True): c.GBTClassifier}
    tree = makers[kind, boosted](featuresCol="features", labelCol=label, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), tree]).fit(df)


def stratified_split(df: DataFrame, stratum: str, key: str, test_percent: int, salt: str = "split") -> DataFrame:
    """``split``: in each stratum the first rows of a hash order, its share rounded down, are test rows.

    The cut of a stratum is a percentile of its hashes, so no stratum is sorted in one task.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}/"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double")
    marked = df.withColumn("_h", h)
    cut = marked.groupBy(F.col(stratum).alias("_s")).agg(F.percentile("_h", test_percent / 100).alias("_c"))
    out = marked.join(cut, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return out.withColumn("split", F.when(F.col("_h") < F.col("_c"), "test").otherwise("train")).drop("_h", "_s", "_c")


def year_split(df: DataFrame, year: str, test_years: list) -> DataFrame:
    return df.withColumn("split", F.when(F.col(year).isin(*test_years), "test").otherwise("train"))


def month_split(df: DataFrame, date: str, test_percent: int, salt: str = "split") -> DataFrame:
    """Whole months by a hash of (year, month)."""
    return hash_split(df.withColumn("_m", F.date_format(date, "yyyy-MM")), "_m", test_percent, salt).drop("_m")


def classification_metrics(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """n and accuracy over complete rows."""
    d = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def stack(df: DataFrame, prefixes: list[str], name: str = "cube") -> DataFrame:
    """One array a row: for each position the columns of that number of every prefix (``lag0``, ``day0``), then the next."""
    from itertools import takewhile

    numbers = list(takewhile(lambda i: all(f"{p}{i}" in df.columns for p in prefixes), range(len(df.columns))))
    return df.withColumn(name, F.array(*[F.array(*[F.col(f"{p}{i}").cast("double") for p in prefixes]) for i in numbers]))


def scaled_coordinates(df: DataFrame, *columns: str) -> DataFrame:
    """Columns ``z_...``: coordinates by their mean and population deviation over all rows."""
    return standard_scale(df.select("*", *[F.col(c).alias(f"z_{c}") for c in columns]), [f"z_{c}" for c in columns], F.lit(True))


def svm_model(df: DataFrame, features: list[str], label: str, regularisation: float = 0.01):
    """A fitted pipeline of an assembler, a scaler and a linear support vector machine."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LinearSVC(labelCol=label, regParam=regularisation, maxIter=30)]
    return Pipeline(stages=stages).fit(df)


def registered_runs(runs: DataFrame, tag: str | None = None, **parameters) -> DataFrame:
    """Runs (run, tag, params: map of text) with a tag and parameters, each with its version: its number among the tag's runs."""
    from functools import reduce

    w = Window.partitionBy("tag").orderBy("run")
    out = runs.withColumn("version", F.row_number().over(w))
    asked = [F.col("tag") == tag] * (tag is not None) + [F.try_element_at("params", F.lit(k)) == str(v) for k, v in parameters.items()]
    return out.where(reduce(lambda a, b: a & b, asked)) if asked else out
