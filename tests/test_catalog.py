"""Every query against its SQL, and rows for those that have none."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from budgetsieve.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows_of(df):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.8g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(found)
        return
    wanted = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
