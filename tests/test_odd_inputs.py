"""Queries on inputs that the supplied tables don't have, against their SQL."""

import glob
import os

import duckdb
import pytest
from test_catalog import rows_of

from budgetsieve.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture
def compared(spark, sf_dir, tmp_path):
    """Compares a query with its SQL over given tables (SQL texts over the supplied ones)."""

    def run(name, **tables):
        c = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        for table, sql in tables.items():
            c.sql(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet, row_group_size 2048)")
        for table in tables:
            c.sql(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet'")
        found, wanted = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
        return found

    return run


def test_baseline_of_zero(compared):
    found = compared("baseline_delta", events="SELECT * REPLACE (CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN -value ELSE value END AS value) FROM events")
    assert {float("inf"), float("-inf")} <= set(found["ratio"]) and found["ratio"].isna().any()


def test_cells_of_unknown_priorities(compared):
    """Alerts that aren't known come last, as in the SQL."""
    compared("allocation_control", orders="SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders")
