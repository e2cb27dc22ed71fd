"""Operators of selection, checks, splits, models and order."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import scalars as sc
from vigil.operators import features, quality, series, spatial


def test_checks_reject(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0)], "id long, v double")
    assert quality.require(df, {"id": "bigint", "v": ""}).count() == 2
    for bad, error in ((lambda: quality.require(df.limit(0), {"id": ""}), ValueError), (lambda: quality.require(df, {"x": ""}), ValueError), (lambda: quality.require(df, {"id": "string"}), TypeError), (lambda: quality.require(df, {"v": ""}, ("v",)), ValueError)):
        with pytest.raises(error):
            bad()
    assert quality.finite_numbers([1, 2.5]) == [1.0, 2.5]
    for bad, error in (([True], TypeError), (["1"], TypeError), ([float("nan")], ValueError), ([float("inf")], ValueError)):
        with pytest.raises(error):
            quality.finite_numbers(bad)
    with pytest.raises(ValueError):
        quality.checked_patch(df, spark.createDataFrame([(9, 1.0)], "id long, new_value double"), ["id"], "v")
    with pytest.raises(ValueError):
        quality.pivot_unique(spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k long, c string, v int"), ["k"], "c", ["a"], "v")


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (2, None)], "a int, b int")
    assert [tuple(r) for r in quality.rows_with_value(df, "a", None).collect()] == [(None, 1)]
    assert quality.rows_with_null(df, "b").count() == 2 and quality.keep_existing(df, ["b", "z"]).columns == ["b"]
    assert quality.columns_like(spark.createDataFrame([(1, 2, 3)], "lag0 int, lag1 int, day0 int"), "lag", "day") == {"lag": ["lag0", "lag1"], "day": ["day0"]}
    assert spark.range(1).select(sc.unprefixed_id(F.lit(9012)), sc.unprefixed_id(F.lit(12))).first() == (12, 12)


def test_splits(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("s"))
    got = {(r.s, r.split): r["count"] for r in features.stratified_split(df, "s", "id", 25).groupBy("s", "split").count().collect()}
    assert all(abs(got[s, "test"] - 4000 / 3 * 0.25) <= 2 for s in range(3))
    again = features.hash_split(df, "id", 20)
    share = again.where("split = 'test'").count() / 4000
    assert 0.17 < share < 0.23 and again.exceptAll(features.hash_split(df, "id", 20)).isEmpty()


def test_stepwise_finds_the_feature(spark):
    rows = [(float(i % 7), float(i % 5), float((i * 37) % 11), float(i % 7 > 3) if i % 13 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    for direction in ("forward", "backward", "both"):
        assert "a" in features.stepwise(df, ["a", "b", "c"], "y", direction)
    with pytest.raises(ValueError):
        features.stepwise(df, ["a"], "y", "sideways")
    model = features.svm_model(df, ["a", "b", "c"], "y")
    assert model.transform(df).where("prediction = y").count() > 340


def test_forecast_by_hand(spark):
    values = [3.0, None, 5.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "label int, v double")
    got = [r.forecast for r in series.rolling_forecast(df, "v", 0.5).orderBy("label").collect()]
    assert got == [None, 3.0, 3.0, 4.0]


def test_greedy_order_by_hand(spark):
    sites = [(5, 0.0, 0.0), (1, 0.0, 1.0), (2, 0.0, 5.0), (3, 0.0, 2.1), (4, 0.0, 2.0)]
    assert spatial.greedy_order(spark.createDataFrame(sites, "site long, lat double, lon double")) == [1, 4, 3, 5, 2]
