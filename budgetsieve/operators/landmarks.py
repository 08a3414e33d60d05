"""A frozen basis from landmarks: the leading right singular vectors of a bounded sample, and projections on it.

The Gram matrix of the landmarks is never formed: tasks return its product with a thin block, and the block's
Krylov space is searched for the leading vectors until their residuals are small. The basis is a table with one
row a dimension, stored once and then applied to any number of rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.functions.expr import hash_order
from budgetsieve.sources.sinks import written
from budgetsieve.sources.workers import ship

#: Rows that a basis is fitted on, in hash order; tasks that multiply them; rows multiplied at a time.
LANDMARKS, TASKS, CHUNK = 20_000, 16, 512


def landmarks(rows: DataFrame, n: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """The first n rows in hash order, written."""
    order = [hash_order("item_id", seed, "landmark"), F.col("item_id")]
    ids = rows.select("item_id").orderBy(*order).limit(n)
    return written(rows.join(ids, "item_id", "left_semi").repartition(TASKS, "item_id"), "landmarks")


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 0, tolerance: float = 1e-10) -> np.ndarray:
    """The k leading eigenvectors (columns) of a positive symmetric matrix, given its products with blocks.

    Blocks span a Krylov space that is kept orthogonal; it grows until the k residuals are under the tolerance
    (relative to the largest value), or until it is the whole space. Signs make the largest entry positive.
    """
    k = min(k, dims)
    width = min(dims, k + 16)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))
    space, images = q, np.zeros((dims, 0))
    while True:
        image = times(q)
        images = np.hstack([images, image])
        values, vectors = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        top = vectors[:, ::-1][:, :k]
        found, largest = space @ top, max(values[-1], 1e-300)
        residual = np.linalg.norm(images @ top - found * values[::-1][:k], axis=0).max() / largest
        room = dims - space.shape[1]
        if residual < tolerance or not room:
            break
        for _ in range(2):
            image = image - space @ (space.T @ image)
        u, s, _ = np.linalg.svd(image, full_matrices=False)
        q = u[:, s > 1e-12 * largest][:, :room]
        if not q.shape[1]:
            break
        q, _ = np.linalg.qr(q - space @ (space.T @ q))
        space = np.hstack([space, q])
    return found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(k)])


def _dense(values: pd.Series, dims: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.array(values.tolist(), np.float64)
    out = np.zeros((len(values), dims))
    for i, on in enumerate(values):
        out[i, np.asarray(on, np.int64)] = 1.0
    return out


def gram_times(rows: DataFrame, column: str, dims: int, bits: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Products of the Gram matrix of rows (arrays of doubles, or of on-bits) with a block; tasks return one each."""
    spark = rows.sparkSession
    ship(spark)

    def times(block: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(sent.value)
            for batch in batches:
                for i in range(0, len(batch), CHUNK):
                    x = _dense(batch[column].iloc[i : i + CHUNK], dims, bits)
                    total += x.T @ (x @ sent.value)
            yield pd.DataFrame({"sum": [total.tobytes()]})

        parts = rows.select(column).mapInPandas(run, "sum binary").collect()  # one row a task, of the landmarks' few
        sent.destroy()
        return sum((np.frombuffer(r["sum"]).reshape(block.shape) for r in parts), np.zeros_like(block))

    return times


def fit_basis(rows: DataFrame, k: int = 96, dims: int = 2048, column: str = "bits", bits: bool = True, n: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """The frozen basis (dim, weights) of k vectors, fitted on n landmarks and written."""
    spark = rows.sparkSession
    basis = leading(gram_times(landmarks(rows.select("item_id", column), n, seed), column, dims, bits), dims, k, seed)
    table = spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(basis)], "dim int, weights array<double>")
    return written(table.coalesce(1), "basis")


def basis_of(table: DataFrame) -> np.ndarray:
    """A stored basis as an array: as many rows as dimensions."""
    return np.array([r["weights"] for r in table.orderBy("dim").collect()])


def project(rows: DataFrame, basis: DataFrame, column: str = "bits", bits: bool = True, name: str = "z") -> DataFrame:
    """Adds the normalised product of each row with a stored basis; for on-bits, the sum of their weights."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(basis_of(basis))

    @F.pandas_udf("array<double>")
    def times(x: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(x), CHUNK):
            part = x.iloc[i : i + CHUNK]
            z = np.stack([sent.value[np.asarray(on, np.int64)].sum(0) for on in part]) if bits else _dense(part, 0, False) @ sent.value
            out += list(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
        return pd.Series(out, dtype=object)

    return rows.withColumn(name, times(column))
