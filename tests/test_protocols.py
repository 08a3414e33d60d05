"""Bases, generated pools, order statistics by counts, member lists, readers and protocols on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetsieve.operators import landmarks as B
from budgetsieve.operators import members as L
from budgetsieve.operators import ranking as R
from budgetsieve.operators import sampling as S
from budgetsieve.operators import stats as T
from budgetsieve.operators import vectors as V
from budgetsieve.plans import loops
from budgetsieve.plans import protocols as PR
from budgetsieve.plans.registry import METHODS
from budgetsieve.sources import mixture, readers, sinks
from test_semantics import vector_pool


def test_landmark_basis(spark):
    r = np.random.default_rng(2)
    on = [sorted(r.choice(200, r.integers(5, 40), replace=False).tolist()) for _ in range(300)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(on)], "item_id long, bits array<int>")
    basis = B.fit_basis(rows, 6, 200, n=1000)
    got = B.basis_of(basis)
    x = np.zeros((300, 200))
    for i, b in enumerate(on):
        x[i, b] = 1
    exact = np.linalg.svd(x, full_matrices=False)[2][:6].T
    assert np.linalg.norm(got @ got.T - exact @ exact.T, 2) < 1e-6 and got.shape == (200, 6)
    assert (np.abs(got).argmax(0) == got.argmax(0)).all()
    z = x @ got
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert np.allclose([p["z"] for p in B.project(rows, basis).orderBy("item_id").collect()], z)
    few = B.landmarks(rows, 50)
    assert few.count() == 50 and {p["item_id"] for p in few.collect()} == {p["item_id"] for p in B.landmarks(rows.repartition(7), 50).collect()}


def test_leading_vectors_of_close_values():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(80, 80)))
    g = q @ np.diag(np.concatenate([[3.0, 2.999999, 1.0], np.linspace(0.9, 0, 77)])) @ q.T
    got = B.leading(lambda b: g @ b, 80, 3)
    assert np.linalg.norm(got @ got.T - q[:, :3] @ q[:, :3].T, 2) < 1e-6
    assert B.leading(lambda b: np.zeros_like(b), 5, 3).shape == (5, 3)


def test_mixture_pool(spark):
    m = mixture.Mixture(targets=2, partitions=8, features=4, scaffolds=20, seed=3)
    numbers = spark.range(800).select(F.col("id").alias("item_id"))
    rows = mixture.mixture_pool(numbers, m).collect()
    assert len(rows) == 1600
    assert {t: sum(r["label"] for r in rows if r["target"] == t) for t in (0, 1)} == {0: 36, 1: 36}
    assert all(abs(np.linalg.norm(r["x"]) - 1) < 1e-9 and 0 <= r["scaffold"] < 20 and 0 <= r["part_id"] < 8 for r in rows)
    again = {(r["target"], r["item_id"]): r["logit"] for r in mixture.mixture_pool(numbers.repartition(5), m).collect()}
    assert again == {(r["target"], r["item_id"]): r["logit"] for r in rows}
    # an alert lowers the logits of all targets, and items of one part are alike
    assert np.mean([r["logit"] for r in rows if r["alert"]]) < np.mean([r["logit"] for r in rows if not r["alert"]]) + 1.0
    z = [r[0] for r in spark.range(4000).select(mixture.normal(F.col("id"), 1, "z")).collect()]
    assert abs(np.mean(z)) < 0.06 and abs(np.std(z) - 1) < 0.04


@pytest.mark.parametrize("rough, in_task", [(10**6, 10**6), (100, 10**6), (100, 0)])
def test_quantiles_by_counts(spark, monkeypatch, rough, in_task):
    monkeypatch.setattr(R, "ROUGH", rough)
    monkeypatch.setattr(R, "IN_TASK", in_task)
    monkeypatch.setattr(R, "MARGIN", 0.02)
    r = np.random.default_rng(1)
    values = {0: r.normal(size=3000), 1: r.integers(0, 4, 500).astype(float), None: np.array([2.5]), 3: r.normal(size=7)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [(0, None)], "target int, v double")
    for q in (0.0, 0.1, 0.5, 0.955, 1.0):
        got = {x["target"]: x["cut"] for x in R.quantiles(rows, "v", q).collect()}
        assert got.keys() == values.keys() and all(abs(got[k] - np.quantile(x, q)) < 1e-12 for k, x in values.items())
    place = {x["target"]: x["cut"] for x in R.quantiles(rows, "v", 0.9, place=lambda n: F.least(n - 1, F.ceil(n * 0.9))).collect()}
    assert all(place[k] == np.sort(x)[min(len(x) - 1, int(np.ceil(len(x) * 0.9)))] for k, x in values.items())


def test_small_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)], None if i % 2 else "x") for i in range(20)], "a long, b array<double>, c string")
    held = sinks.small(df)
    assert held.schema == df.schema and sorted(map(tuple, held.collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(sinks, "SMALL_ROWS", 5)
    assert sorted(map(tuple, sinks.small(df).collect())) == sorted(map(tuple, df.collect()))
    assert sinks.small(df.limit(0)).count() == 0


def test_ranks_of_values(spark):
    d = [("a", v) for v in (3.0, 1.0, 1.0, -2.0, 0.0, float("nan"), float("inf"))] + [("b", -1.0), ("b", None)]
    rows = spark.createDataFrame(d, "m string, delta double")
    got = {(r["m"], r["v"]): (r["n"], r["r"]) for r in T.value_ranks(T.finite(rows, "delta"), ["m"], F.col("delta")).collect()}
    assert got == {("a", -2.0): (1, 1.0), ("a", 0.0): (1, 2.0), ("a", 1.0): (2, 3.5), ("a", 3.0): (1, 5.0), ("b", -1.0): (1, 1.0)}
    w = {r["m"]: (r["w_plus"], r["w_minus"], r["n"]) for r in T.wilcoxon(rows, ["m"]).collect()}
    assert w == {"a": (1.5 + 1.5 + 4.0, 3.0, 4), "b": (0.0, 1.0, 1)}
    run = {r["v"]: r["before"] for r in R.running(spark.createDataFrame([(v, 2) for v in range(50)], "v int, n int"), "v", "n").collect()}
    assert run == {v: 2 * v for v in range(50)}


def test_member_lists(spark):
    pool = spark.createDataFrame([(t, i, (i * 7 + t) % 5) for t in (0, 1) for i in range(60) if (i * 7 + t) % 5 != 3], "target int, item_id long, part_id int")
    lists = L.member_lists(pool)
    offsets = {(r["target"], r["part_id"]): (r["start"], r["n"]) for r in lists.offsets.collect()}
    assert offsets[0, 0] == (0, 12) and offsets[1, 4] == (36, 12) and (0, 3) not in offsets
    want = spark.createDataFrame([(0, 2), (1, 4), (1, 3), (0, 2)], "target int, part_id int")
    got = sorted((r["target"], r["part_id"], r["item_id"]) for r in lists.slice_of(want).collect())
    assert got == sorted((r["target"], r["part_id"], r["item_id"]) for r in pool.collect() if (r["target"], r["part_id"]) in ((0, 2), (1, 4)))
    assert lists.slice_of(want, 3).count() == 6


@pytest.mark.parametrize("split", ["40", "128m"])
def test_line_numbers_in_splits(spark, tmp_path, split):
    lines = [f"C{i}" if i % 3 else f"C{i} id{i} more" for i in range(40)]
    (tmp_path / "one.ism").write_text("\n".join(x + ("\n\n" if i % 5 == 0 else "") for i, x in enumerate(lines)) + "\n")
    (tmp_path / "two.ism").write_text("N\n\nO\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {(r["smiles"], r["mol_id"]) for r in readers.read_ism(spark, str(tmp_path / "*.ism"), 1).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"C{i}", f"one_{i}" if i % 3 else f"id{i}_more") for i in range(40)} | {("N", "two_0"), ("O", "two_1")}


def test_result_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"k,v\n1,{ord(name)}\n")
    paths = [str(tmp_path / f"{x}.csv") for x in ("a", "gone", "b")]
    with pytest.raises(FileNotFoundError, match="gone"):
        readers.read_existing(spark, paths, "k int, v double")
    assert sorted(r["v"] for r in readers.read_existing(spark, paths, "k int, v double", strict=False).collect()) == [97.0, 98.0]
    with pytest.raises(ValueError, match="no result"):
        readers.read_existing(spark, paths[1:2], "k int, v double", strict=False)
    tags = [f"1:{paths[0]}", f"1:{paths[2]}"]
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_tagged(spark, tags, "k int, v double", ["k"])
    assert readers.read_tagged(spark, [tags[0], f"2:{paths[2]}"], "k int, v double", ["k"]).count() == 2
    rows = spark.range(5)
    assert readers.valid_rows(rows, F.col("id") > 2).count() == 2
    with pytest.raises(ValueError, match="no valid molecules"):
        readers.valid_rows(rows, F.col("id") > 9, "molecules")
    assert readers.parse_comparisons("a:b, c:d:e") == [("a", "b"), ("c", "d:e")]
    with pytest.raises(ValueError):
        readers.parse_comparisons("a")
    (tmp_path / "names.txt").write_text(" ABL1 \n\nEgfr\n")
    assert [r["name"] for r in readers.read_list(spark, str(tmp_path / "names.txt")).orderBy("n").collect()] == ["abl1", "egfr"]


def test_arms_fill_their_batch(spark):
    """An arm of two items can't give its quota; the other arm's next best fill the batch."""
    rows = [(0, i, 0 if i < 2 else 1, int(i % 9 == 0), i / 60.0) for i in range(60)]
    pool = spark.createDataFrame(rows, "target int, item_id long, part_id int, label int, mu double")
    picked = S.quota_fill(pool, 10, 20).collect()
    assert sorted(r["item_id"] for r in picked) == [0, 1, *range(42, 60)]
    by_id = S.quota_fill(pool, 15, 16, by_id=True).collect()
    assert sorted(r["item_id"] for r in by_id) == [0, 1, *range(45, 59)]
    full = vector_pool(spark)
    final, arms, log = loops.arm_bandit(full, protocol=loops.Protocol(initial=16, rounds=2, query=10, selected=3))
    assert [x["labeled"] for x in log] == [26, 36]
    assert METHODS["true_budgeted_reliable"].explore == "ucb"


def test_matched_rounds_replayed(spark):
    """Two rounds of the greedy acquisition, replayed with the fitted members in plain Python."""
    pool = vector_pool(spark)
    p = loops.Protocol(initial=16, rounds=2, query=8, members=3, final_blend=0.5)
    found, ranked = PR.matched(pool, ("greedy_surrogate", "budgeted_reliable_random_parts"), p, k=20)
    got = {r["method"]: r for r in found.collect()}
    assert {m: r["queried"] for m, r in got.items()} == {"greedy_surrogate": 32, "budgeted_reliable_random_parts": 32}
    items = {r["item_id"]: r for r in pool.collect()}
    labeled = {r["item_id"] for r in S.initial_labels(pool, 16).collect()}
    mu_of = lambda seed: _mu(items, V.logistic_ensemble(pool.where(F.col("item_id").isin(sorted(labeled))), 3, seed).collect())
    for r in range(2):
        mu = mu_of(r)
        labeled |= set(sorted((i for i in items if i not in labeled), key=lambda i: (-mu[i], i))[:8])
    assert got["greedy_surrogate"]["queried_hits"] == sum(items[i]["label"] for i in labeled)
    mu = mu_of(2)
    far = lambda i, y: min(np.linalg.norm(np.array(items[i]["x"]) - np.array(items[j]["x"])) for j in labeled if items[j]["label"] == y)
    ids = sorted(items)
    z = lambda v: (v - v.mean()) / (v.std() + 1e-8)
    blended = z(np.array([mu[i] for i in ids])) + 0.5 * (z(np.array([-far(i, 1) for i in ids])) - 0.5 * z(np.array([-far(i, 0) for i in ids])))
    order = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (-blended[ids.index(i)], i)))}
    clean = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (items[i]["alert"], i)))}
    size = {s: sum(items[i]["scaffold"] == s for i in ids) for s in {items[i]["scaffold"] for i in ids}}
    novel = {i: k for k, i in enumerate(sorted(ids, key=lambda i: (size[items[i]["scaffold"]], i)))}
    rrf = {i: 1 / (60 + order[i]) + 0.18 / (60 + clean[i]) + 0.25 / (60 + novel[i]) for i in ids}
    want = sorted(ids, key=lambda i: (-rrf[i], i))
    rows = ranked.where("method = 'greedy_surrogate'").orderBy("rank").collect()
    assert [r["item_id"] for r in rows] == want
    assert got["greedy_surrogate"]["hits"] == sum(items[i]["label"] for i in want[:20])


def _mu(items, members):
    return {i: np.mean([1 / (1 + np.exp(-(np.dot(m["w"], r["x"]) + m["b"]))) for m in members]) for i, r in items.items()}


def test_run_metrics_and_refit(spark):
    pool = vector_pool(spark)
    final, log = loops.full_pool(pool, "greedy_surrogate", loops.Protocol(initial=16, rounds=1, query=8, round_blend=0.25, final_blend=0.5))
    row = loops.run_metrics(final, log, (10, 50)).collect()
    assert len(row) == 1 and row[0]["queried"] == 24 and row[0]["10_hits"] <= row[0]["50_hits"] and 0 <= row[0]["bedroc"] <= 1
    labeled = S.initial_labels(pool, 60, 3).drop("place")
    r = loops.calibrated(pool, labeled, loops.Protocol(members=2)).collect()[0]
    assert r["n_train"] + r["n_calibration"] == labeled.count() and r["n_test"] == 120 - labeled.count() and 0 <= r["coverage"] <= 1


def test_encodings(spark):
    pool = vector_pool(spark).select("item_id", "target", "label", "x")
    rows = PR.encodings(pool, {"whole": F.col("x"), "half": F.slice("x", 1, 2)}, 4, 0.5, 3, 10).collect()
    assert {r["encoding"] for r in rows} == {"whole", "half"}
    assert all(r["parts"] <= 4 and 0 <= r["topk_overlap"] <= 1 for r in rows) and {r["agreement"] for r in rows if r["encoding"] == "whole"} == {1.0}
