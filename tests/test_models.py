"""Trees, lists and clusters against brute force on small pools."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from budgetsieve.operators import lists as N
from budgetsieve.operators import trees as T
from budgetsieve.operators import vectors as V
from budgetsieve.plans import loops
from budgetsieve.plans.registry import METHODS
from test_semantics import vector_pool


def hashed(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(int(v).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h


def brute_tree(x, y, tree, seed):
    """The published rule with the same draws, row by row: {node: (feature, cut, p)}."""
    n, n1 = len(y), sum(y)
    c0, c1 = n / (2 * (n - n1)), n / (2 * n1)
    wanted, out = int(np.sqrt(len(x[0]))), {}

    def grow(node, rows):
        pos = sum(y[i] for i in rows)
        p = c1 * pos / (c1 * pos + c0 * (len(rows) - pos))
        out[node] = (None, None, p)
        if pos in (0, len(rows)):
            return
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        order = sorted(range(len(x[0])), key=lambda f: signed(hashed(seed, tree, node, f)))
        features = [f for f in order if len({x[i][f] for i in rows}) > 1][:wanted]
        best = None
        for f in features:
            low, high = min(x[i][f] for i in rows), max(x[i][f] for i in rows)
            cut = low + (hashed(seed, tree, node, f, 1) >> 11) / 2**53 * (high - low)
            left = [i for i in rows if x[i][f] <= cut]
            right = [i for i in rows if x[i][f] > cut]
            if not left or not right:
                continue
            score = 0.0
            for side in (left, right):
                w1 = c1 * sum(y[i] for i in side)
                w0 = c0 * (len(side) - sum(y[i] for i in side))
                score += (w1 * w1 + w0 * w0) / (w1 + w0)
            if best is None or score > best[0] + 1e-12:
                best = (score, f, cut, left, right)
        if best:
            out[node] = (best[1], best[2], p)
            grow(2 * node, best[3])
            grow(2 * node + 1, best[4])

    grow(1, list(range(len(y))))
    return out


@pytest.mark.parametrize("in_task", [20_000, 30])
def test_extra_trees_against_brute_force(spark, in_task):
    rows = sorted(vector_pool(spark).collect(), key=lambda r: r["item_id"])
    x, y = [r["x"] for r in rows], [r["label"] for r in rows]
    found = T.extra_trees(vector_pool(spark), 3, seed=7, in_task=in_task).collect()
    got = {}
    for r in found:
        got.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["p"])
    assert got == {t: brute_tree(x, y, t, 7) for t in range(3)}


@pytest.mark.parametrize("kind", ["extra", "forest"])
def test_variance_of_votes(spark, kind):
    pool = vector_pool(spark)
    labeled = pool.where("item_id < 80")
    trees = T.extra_trees(labeled, 10, seed=1) if kind == "extra" else T.forest(labeled, 10, seed=1)
    nodes = {(r["tree"], r["node"]): r for r in trees.collect()}
    roots = {}
    for t, n in nodes:
        roots[t] = min(n, roots.get(t, n))
    assert len(roots) == 10
    for r in T.score_trees(pool, trees).collect():
        votes = []
        for t, n in roots.items():
            while (at := nodes[t, n])["feature"] is not None:
                n = at["left"] if r["x"][at["feature"]] <= at["cut"] else at["right"]
            votes.append(at["p"])
        assert abs(r["mu"] - np.mean(votes)) < 1e-12 and abs(r["u_epi"] - np.var(votes)) < 1e-12


def test_trees_by_key(spark, monkeypatch):
    """Keys are grown together as if alone; keys without positives vote their rate; models take passes of few bytes."""
    pool = vector_pool(spark).withColumn("target", (F.col("item_id") % 3).cast("int")).withColumn("label", F.when(F.col("target") == 2, 0).otherwise(F.col("label")))
    labeled = pool.where("item_id < 80")
    monkeypatch.setattr(T, "MODEL_BYTES", 100)
    got = {r["item_id"]: r for r in V.extra_tree_scores(pool, labeled, 9, 3, ["target"]).collect()}
    assert len(got) == 120 and all(r["mu"] == 0 == r["u_epi"] for i, r in got.items() if i % 3 == 2)
    alone = V.extra_tree_scores(pool.where("target = 1"), labeled.where("target = 1"), 9, 3).collect()
    assert {r["item_id"]: r["mu"] for r in alone} == {i: r["mu"] for i, r in got.items() if i % 3 == 1}
    means = [np.mean([r["mu"] for i, r in got.items() if r["label"] == y and i % 3 < 2]) for y in (0, 1)]
    assert means[1] > means[0]
    assert V.extra_tree_scores(pool.limit(0), labeled, 2).count() == 0


def test_extra_methods(spark):
    assert {METHODS[f"et_{x}"].acquire for x in ("greedy", "uncertainty", "ucb")} == {"greedy", "uncertainty", "ucb"}
    final, log = loops.full_pool(vector_pool(spark), "et_ucb", loops.Protocol(initial=16, rounds=1, query=8, members=1))
    assert [x["labeled"] for x in log] == [24] and final.count() == 120


@pytest.mark.parametrize("keys", [[], ["target"]])
def test_nearest_in_lists(spark, monkeypatch, keys):
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    monkeypatch.setattr(N, "GROUP_ROWS", 11)
    pool = vector_pool(spark).withColumn("target", (F.col("item_id") % 2).cast("int"))
    reference = pool.where("item_id % 3 = 0").unionByName(pool.where("item_id = 6").withColumn("item_id", F.lit(1000).cast("long")))
    rows, held = pool.collect(), reference.collect()
    got = {r["item_id"]: r["nearest"] for r in N.nearest(pool, reference, 4, keys, sent_bytes=0).collect()}
    sent = {r["item_id"]: r["nearest"] for r in N.nearest(pool, reference, 4, keys).collect()}
    assert len(got) == len(sent) == 120
    for r in rows:
        want = sorted(np.linalg.norm(np.array(r["x"]) - np.array(h["x"])) for h in held if not keys or h["target"] == r["target"])[:4]
        assert np.allclose(got[r["item_id"]], want, atol=1e-9) and np.allclose(sent[r["item_id"]], want, atol=1e-9)
    assert N.nearest(pool, reference.where("item_id < 0"), 4, keys, sent_bytes=-1).count() == 0


def test_centres_are_pruned_exactly():
    r = np.random.default_rng(3)
    c = np.concatenate([r.normal(size=(40, 5)) + 10 * k for k in range(4)] + [np.zeros((2, 5))])
    x = np.concatenate([r.normal(size=(200, 5)) + 10 * r.integers(0, 4, (200, 1)), np.zeros((1, 5))])
    at, far = N.Centres(c).assign(x)
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    assert (at == d.argmin(1)).all() and np.allclose(far, d.min(1)) and at[-1] == 160


def test_minibatch_kmeans(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4)) + 6 * r.integers(0, 5, (600, 1))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, x array<double>")
    centres = lambda df: np.array([c["centroid"] for c in df.orderBy("part_id").collect()])
    loss = lambda c: (N.k_nearest(x, c, 1)[0] ** 2).sum()
    mini, full = centres(N.minibatch_kmeans(pool, 8, batch=100)), centres(V.kmeans(pool, 8))
    assert mini.shape == (8, 4) and loss(mini) < 1.05 * loss(full)
    again = centres(N.minibatch_kmeans(pool.repartition(3), 8, batch=100))
    assert np.allclose(mini, again)
