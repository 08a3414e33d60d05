"""Sinks and the shared folder for checkpoints."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset and all runs on one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_budgetsieve_tables", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.sparkContext._budgetsieve_tables = "file://" + tempfile.mkdtemp(prefix="budgetsieve-tables-")
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes up to which a small table is held in the plan.
SMALL_ROWS, SMALL_BYTES = 10_000, 4 << 20


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """A table that should have few rows, made first: its size is then known when the join is planned.

    Up to ``SMALL_ROWS`` rows are held in the plan, larger tables are written. Spark broadcasts it if it is under
    spark.sql.autoBroadcastJoinThreshold, and joins by key otherwise.
    """
    table = df.limit(SMALL_ROWS + 1).toArrow()
    if table.num_rows > SMALL_ROWS or table.nbytes > SMALL_BYTES:
        return written(df, name)
    return df.sparkSession.createDataFrame(table, df.schema)


def in_passes(sized: Sequence[tuple], most: int) -> list[list]:
    """Things (thing, size) in order, in groups of that size at most, or of one thing."""
    out: list[list] = []
    room = 0
    for thing, n in sized:
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(thing)
        room -= n
    return out


def write_json(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_gzip_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path, header=True)
