"""What queries write: tables that don't grow with cells, methods, rounds or passes."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from budgetsieve.operators import lists as N
from budgetsieve.operators import vectors as V
from budgetsieve.plans import catalog_items, loops
from budgetsieve.plans import protocols as PR
from budgetsieve.plans.catalog import QUERIES
from budgetsieve.sources.pools import Pools
from budgetsieve.sources.sinks import shared_dir
from test_semantics import vector_pool


@pytest.fixture
def wrote(spark, sf_dir):
    """Rows of the tables that a query writes, by table, and their bytes."""

    def run(name):
        shared = shared_dir(spark).removeprefix("file://")
        before = set(os.listdir(shared))
        assert QUERIES[name](spark, sf_dir).collect()
        made = {d: glob.glob(f"{shared}/{d}/*.parquet") for d in set(os.listdir(shared)) - before}
        return {d: sum(pq.read_metadata(f).num_rows for f in fs) for d, fs in made.items()}, sum(os.path.getsize(f) for fs in made.values() for f in fs)

    return run


def test_budget_cells_keep_the_pool_once(wrote, spark, sf_dir):
    """No table has a row for each of the thirty cells of an order."""
    rows, _ = wrote("budget_cells")
    assert max(rows.values()) < 2 * Pools(spark, sf_dir).o.count()


@pytest.mark.parametrize("keys", [[], ["target"]])
def test_lists_in_passes(spark, monkeypatch, keys):
    """Lists that don't fit at once give the same distances, and no row of the pool is written."""
    pool = vector_pool(spark).withColumn("target", (F.col("item_id") % 2).cast("int"))
    same = pool.where("item_id = 6").withColumn("item_id", F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1080).cast("long"))))
    reference = pool.where("item_id % 3 = 0").unionByName(same)
    monkeypatch.setattr(N, "PASS_BYTES", 600)
    monkeypatch.setattr(N, "BLOCK_ROWS", 5)
    rows, held, sent = pool.collect(), reference.collect(), []
    searching, made = N._searching, N.written
    monkeypatch.setattr(N, "_searching", lambda b, k: sent.append(sum(h.x.nbytes for h in b.value.values())) or searching(b, k))
    monkeypatch.setattr(N, "written", lambda df, name: sent.append(name) or made(df, name))
    got = {r["item_id"]: r["nearest"] for r in N.nearest(pool, reference, 4, keys, sent_bytes=0).collect()}
    assert [x for x in sent if isinstance(x, str)] == ["reference", "lists"] and len(sent) > 4
    assert len(got) == 120
    for r in rows:
        want = sorted(np.linalg.norm(np.array(r["x"]) - np.array(h["x"])) for h in held if not keys or h["target"] == r["target"])[:4]
        assert np.allclose(got[r["item_id"]], want, atol=1e-9)


def test_large_reference_writes_no_pool(wrote, spark, sf_dir, monkeypatch):
    """knn_mean_distance with a reference too large to be sent at once writes that reference alone."""
    search = V.nearest
    monkeypatch.setattr(V, "nearest", lambda *a: search(*a, sent_bytes=0))
    monkeypatch.setattr(N, "PASS_BYTES", 8192, raising=False)
    rows, _ = wrote("knn_mean_distance")
    assert sum(rows.values()) < Pools(spark, sf_dir).v.count()


def test_matched_rounds_write_no_vectors(spark, sf_dir, monkeypatch):
    """Of a round scores and the batch are written, not the vectors of the pool for each method."""
    made, vectors = PR.written, []

    def written(df, name):
        out = made(df, name)
        vectors.append(out.count() if "x" in out.columns else 0)
        return out

    monkeypatch.setattr(PR, "written", written)
    pools = Pools(spark, sf_dir)
    pool = catalog_items._vector_pool(pools).where("target < 2")
    found, _ = PR.matched(pool, ("greedy_surrogate", "arm_ucb"), loops.Protocol(initial=32, rounds=2, query=16, members=1, final_blend=0.5), k=20)
    assert {r["queried"] for r in found.collect()} == {64}
    assert sum(vectors) == 2 * 2 * 64
