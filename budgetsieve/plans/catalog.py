"""The catalogue of queries: each name with its plan and the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetsieve.sources.pools import SQL, Pools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, pools: str = "", sql: str = ""):
    """Registers a plan over pools; its SQL may use the pools named (letters)."""

    def register(plan: Callable[[Pools], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Pools(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            body = sql.strip()
            heads = ", ".join(SQL[p] for p in pools)
            if heads:
                body = f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
            ORACLE_SQL[name] = body
        return plan

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns as rounded doubles; the zero added turns -0 into 0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in columns})


def load() -> None:
    """Imports the modules that fill the catalogue."""
    from budgetsieve.plans import catalog_items, catalog_metrics, catalog_reports  # noqa: F401


load()
