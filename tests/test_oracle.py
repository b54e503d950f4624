"""Every query with an oracle gives DuckDB's rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "null"
        if isinstance(v, float | np.floating):
            return str(int(v)) if float(v).is_integer() else f"{v:.6g}"
        return str(v)

    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(spark, duck, key):
    mine, theirs = normal(QUERIES[key](spark, SF).toPandas()), normal(duck.execute(ORACLE[key]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
