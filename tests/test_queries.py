"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from vigil.plans import load, registry

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, (float, np.floating)) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{float(x):.9g}"
    if isinstance(x, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(x))
    return str(x)


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(map(plain, r)) for r in pdf[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = table(registry.queries()[name](spark, SF).toPandas())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        assert got == table(duck.execute(sql).df())
