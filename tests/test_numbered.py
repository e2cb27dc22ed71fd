"""Positions over ranges equal those of one sort."""

import random

from pyspark.sql import functions as F

from vigil.operators.shared import numbered


def test_positions(spark):
    rng = random.Random(1)
    values = [rng.randrange(500) for _ in range(2000)] + [None] * 5
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = numbered(df, "v").collect()
    assert sorted(r.position for r in got) == list(range(len(values)))
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted(values, key=lambda v: (v is not None, v or 0))
    assert numbered(df.limit(0), "v").count() == 0
    assert [r.position for r in numbered(df.where("v is not null"), F.desc("v"), "i").where("position < 3").orderBy("position").collect()] == [0, 1, 2]
