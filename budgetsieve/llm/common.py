"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = Path(__file__).resolve().parents[2]

#: Rows of text in one Arrow batch; texts may be long, so batches stay short.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    Workers that find the package on PYTHONPATH need nothing; others get a zip of its sources.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE_ROOT) in paths or getattr(spark.sparkContext, "_budgetsieve_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted((PACKAGE_ROOT / "budgetsieve").rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE_ROOT))
    target = Path(tempfile.mkdtemp(prefix="budgetsieve-")) / "budgetsieve.zip"
    target.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._budgetsieve_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_budgetsieve_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="budgetsieve-shared-")
        spark.sparkContext._budgetsieve_shared = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def chunked(batches, limit: int, columns: tuple[str, ...] = ("doc_id",)):
    """Rows of Arrow batches as (columns, texts) of about ``limit`` characters of text each; one column comes bare."""
    held, texts, size = [[] for _ in columns], [], 0
    give = lambda: (held[0] if len(columns) == 1 else held, texts)
    for batch in batches:
        for *row, text in zip(*[batch[c].tolist() for c in columns], batch["text"]):
            for values, value in zip(held, row):
                values.append(value)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield give()
                held, texts, size = [[] for _ in columns], [], 0
    if texts:
        yield give()


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a short text of digits and ASCII signs, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    halves = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4]))"
    return f"xor(list_reduce({halves}, lambda c, x: xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295)"


_caches: dict[str, object] = {}


def own_cache(name: str, cache) -> None:
    """Tells that a worker process now fills this cache: those of other operators are emptied.

    Worker processes live on between stages, and what they remember counts against the executor; what
    Arrow holds of earlier batches is given back as well.
    """
    _caches[name] = cache
    others = [other for other in _caches if other != name]
    for other in others:
        _caches.pop(other).clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
