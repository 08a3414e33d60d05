"""Models at sizes that the supplied tables don't have: deep trees, and trees of a key in several passes."""

import numpy as np
from pyspark.sql import functions as F

from budgetsieve.operators import trees as T
from budgetsieve.operators import vectors as V


def test_deep_trees(spark):
    """Trees go down to pure nodes however deep these lie; children have one number wherever a node is split."""
    rows = spark.createDataFrame([(i, i % 2, [5.0**-i]) for i in range(250)], "item_id long, label int, x array<double>")
    trees = T.extra_trees(rows, 3, 1).toArrow().to_pylist()
    assert max(r["node"] for r in trees) >= 1 << 62
    assert {r["p"] for r in trees if r["feature"] is None} == {0.0, 1.0}
    nodes = [(n,) for n in (1, 5, (1 << 58) - 1, 1 << 58, (1 << 58) + 1, 1 << 62, (1 << 63) - 1)]
    told = spark.createDataFrame(nodes, "node long").select("node", T._child(F.lit(0)), T._child(F.lit(1))).collect()
    assert all(tuple(r)[1:] == T._children(r["node"]) for r in told)
    assert all(r["mu"] == r["label"] and r["u_epi"] == 0 for r in V.extra_tree_scores(rows, rows, 3, 1).collect())


def test_trees_in_passes(spark, monkeypatch):
    """A key's trees that don't fit at once give the votes that they give at once."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(r.random() < 0.4), r.normal(size=4).tolist()) for i in range(300)], "item_id long, label int, x array<double>")
    labeled = rows.where("item_id < 200")
    read = lambda: {x["item_id"]: (x["mu"], x["u_epi"]) for x in V.extra_tree_scores(rows, labeled, 12, 5).collect()}
    wanted = read()
    sent, voting = [], T._voting
    monkeypatch.setattr(T, "MODEL_BYTES", 3 * 28 * 2 * 200)
    monkeypatch.setattr(T, "_voting", lambda b: sent.append(sum(len(p.p) for p in b.value.values())) or voting(b))
    got = read()
    assert len(sent) > 1 and max(sent) * 28 <= T.MODEL_BYTES
    assert set(got) == set(wanted) and all(np.allclose(got[i], wanted[i], atol=1e-12) for i in got)
