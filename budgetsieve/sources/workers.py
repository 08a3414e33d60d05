"""Lets Python workers import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package's sources to workers, once a session, unless they find it on PYTHONPATH."""
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or getattr(context, "_budgetsieve_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="budgetsieve-")) / "budgetsieve.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "budgetsieve").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    context._budgetsieve_shipped = True
