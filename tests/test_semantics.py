"""Semantics that differ from the obvious SQL, on small pools."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetsieve.functions import expr as E
from budgetsieve.operators import allocation as A
from budgetsieve.operators import lists as N
from budgetsieve.operators import metrics as M
from budgetsieve.operators import ranking as R
from budgetsieve.operators import reporting as P
from budgetsieve.operators import sampling as S
from budgetsieve.operators import stats as T
from budgetsieve.operators import vectors as V
from budgetsieve.plans import loops
from budgetsieve.plans.registry import METHODS, final_scores
from budgetsieve.sources import readers, sinks
from budgetsieve.streaming import upkeep


@pytest.fixture
def pool(spark):
    rows = [(0, i, int(i % 5 == 0), (i * 37 % 50) / 50.0, int(i % 7 == 0), i % 6, i % 4, (i * 13 % 50) / 50.0, (i * 11 % 50) / 50.0) for i in range(50)]
    return spark.createDataFrame(rows, "target int, item_id long, label int, mu double, alert int, scaffold long, part_id int, u_conf double, u_epi double")


def test_ranks_are_positional(spark):
    rows = spark.createDataFrame([(0, i, 0.5) for i in (3, 1, 2)], "target int, item_id long, mu double")
    got = {r["item_id"]: r["r"] for r in rows.withColumn("r", R.rank(F.col("mu").desc())).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_range_rank_equals_window_rank(spark, pool):
    ranked = R.range_rank(pool, [F.col("mu").desc(), F.col("item_id").asc()]).withColumn("w", R.rank(F.col("mu").desc()))
    assert ranked.where("rank <> w").count() == 0
    assert ranked.count() == 50


def test_every_method_orders_the_pool(pool):
    kinds = {(m.final, m.options): name for name, m in METHODS.items()}  # one method of each final score
    for name in kinds.values():
        out = final_scores(pool, name)
        assert out.count() == 50
        assert out.where("final is null or isnan(final)").count() == 0


def test_ece_leaves_out_one_and_bins_take_it(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 0.25, 0)], "target int, item_id long, mu double, label int")
    assert abs(M.ece(rows).first()["ece"] - 0.125) < 1e-12
    assert {r["bin"] for r in M.reliability(rows).collect()} == {9, 2}


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(E.half_even(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 2, 2]


def test_bedroc_edges(spark):
    rows = spark.createDataFrame([(0, i, 1, i) for i in range(4)] + [(1, i, 0, i) for i in range(4)], "target int, item_id long, label int, rank int")
    got = {r["target"]: r["bedroc"] for r in M.bedroc(rows).collect()}
    assert got == {0: 1.0, 1: None}


def test_aubc_of_one_round_is_zero(spark):
    log = spark.createDataFrame([(0, 1, 5, 10)], "target int, round int, hits long, queried long")
    assert M.aubc_legacy(log).first()["aubc"] == 0.0


def test_sign_test_goldens(spark):
    rows = [("a", 1.0)] * 2 + [("a", -1.0)] * 9 + [("b", 1.0)] * 14 + [("c", 0.0)]
    d = spark.createDataFrame(rows, "method string, delta double")
    got = {r["method"]: r["p"] for r in T.sign_test(d, ["method"]).collect()}
    assert abs(got["a"] - 0.0654296875) < 1e-12
    assert abs(got["b"] - 2 / 2**14) < 1e-12
    assert got["c"] == 1.0
    assert abs(T.sign_p(2, 11) - 0.0654296875) < 1e-12


def test_mann_whitney_golden(spark):
    # U = 7 of 10 x 10: seven pairs in which the first is higher
    first, second = [*range(9), 16.5], [*range(10, 20)]
    rows = spark.createDataFrame([("k", "a", float(v)) for v in first] + [("k", "b", float(v)) for v in second], "k string, g string, v double")
    r = T.mann_whitney(rows, ["k"], "v", "g", "a", "b").first()
    assert r["u"] == 7.0
    assert abs(r["z"] + 3.2127) < 1e-3


def test_permutation_exact(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (1.0, -1.0)], "m string, delta double")
    got = {r["m"]: r["p"] for r in T.permutation_exact(d, ["m"]).collect()}
    assert got == {"a": 0.25, "b": 1.0}


def test_wilcoxon_drops_zeros(spark):
    d = spark.createDataFrame([("a", v) for v in (0.0, 1.0, -1.0, 2.0)], "m string, delta double")
    r = T.wilcoxon(d, ["m"]).first()
    assert (r["w_plus"], r["w_minus"], r["n"]) == (4.5, 1.5, 3)


def test_amortization_golden(spark):
    costs = spark.createDataFrame([(1.905, 51.291, 0.766)], "full double, `index` double, online double")
    assert abs(P.amortization(costs, [1]).first()["speedup"] - 1.905 / 52.057) < 1e-9


def test_empty_defaults(spark):
    one = spark.createDataFrame([(0, 1, 1.0, [1, 2], [1.0, 0.0])], "target int, item_id long, score double, bits array<int>, x array<double>")
    assert M.mean_pairwise_tanimoto(one, 5, ["target"]).first()["distance"] == 1.0
    assert M.mean_pairwise_cosine(one, 5, ["target"]).first()["distance"] == 0.0


def test_stratified_split_leaves_one(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 3, 0)], "target int, item_id long, label int")
    got = {r["item_id"]: r["calibration"] for r in M.stratified_split(rows).collect()}
    assert got[1] is False and sum(got.values()) == 1


def test_samples_are_nested_and_bounded(spark, pool):
    small = {r["item_id"] for r in S.reservoir_fixed(pool, 2).collect()}
    large = {r["item_id"] for r in S.reservoir_fixed(pool, 5).collect()}
    assert small <= large and len(small) == 8 and len(large) == 20
    labels = S.initial_labels(pool, 16)
    assert labels.where("label = 1").count() == 1 and labels.count() == 16
    prefix = S.nested_prefix(pool, [5, 10]).collect()
    assert {r["item_id"] for r in prefix if r["size"] == 5} <= {r["item_id"] for r in prefix if r["size"] == 10}
    assert S.upsample(pool, 120).count() == 120


def test_batch_is_filled_where_too_few(pool):
    none = pool.select("target", "part_id").distinct().where("part_id = 99")
    assert A.select_batch(pool, none, 10, F.col("mu")).count() == 10


def test_bandit_rewards(spark, pool):
    parts = pool.select("target", "part_id").distinct()
    arms = A.bandit_init(pool.where("item_id < 8"), parts)
    assert arms.count() == 4
    after = A.bandit_update(arms, parts.where("part_id = 1"), pool.where("part_id = 2"))
    before = {r["part_id"]: (r["reward_sum"], r["pull_count"]) for r in arms.collect()}
    got = {r["part_id"]: (r["reward_sum"], r["pull_count"]) for r in after.collect()}
    assert got[1] == (before[1][0], before[1][1] + 1) and got[2] == before[2]


def test_one_row_raises(spark):
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="more than one row"):
        P.one_row(twice, ["k"]).collect()
    assert P.one_row(twice.where("v = 2"), ["k"]).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "actives.ism").write_text("CCO id 1\n\nCCC\n  CCN x\n")
    rows = readers.read_ism(spark, str(tmp_path / "actives.ism"), 1).collect()
    assert [(r["smiles"], r["label"]) for r in rows] == [("CCO", 1), ("CCC", 1), ("CCN", 1)]
    assert rows[0]["mol_id"] == "id_1" and rows[1]["mol_id"].startswith("actives_")
    assert readers.read_smi(spark, str(tmp_path / "actives.ism"), 0).first()["mol_id"] == "id"
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("ChEMBL_ID\tcanonical_smiles\nA\tCC\n\tCO\nB\t \n")
    tsv = readers.read_tsv(spark, str(tmp_path / "m.tsv.gz"), {"mol_id": ["molecule_chembl_id", "chembl_id"], "smiles": ["canonical_smiles", "smiles"]})
    assert [tuple(r) for r in tsv.collect()] == [("A", "CC")]
    assert readers.line_counts(spark, str(tmp_path / "actives.ism")).first()["n"] == 3
    assert len(readers.digests(spark, str(tmp_path / "actives.ism")).first()["sha256"]) == 64
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    P.to_csv(df, str(tmp_path / "out"), one_file=True)
    assert readers.read_results(spark, str(tmp_path / "out"), "a int, b double", ["a"]).collect()[0]["b"] == 2.5
    assert readers.read_tagged(spark, [f"7:{tmp_path / 'out'}"], "a int, b double").first()["seed"] == 7
    assert P.markdown(df).splitlines()[-1] == "| 1 | 2.5 |"
    sinks.write_gzip_tsv(df, str(tmp_path / "tsv"))
    sinks.write_json(str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')


def vector_pool(spark, n=120):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 6))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.6).astype(int)
    rows = [(0, i, int(y[i]), i % 5 == 0 and 1 or 0, i % 9, i % 6, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "target int, item_id long, label int, alert int, scaffold long, part_id int, x array<double>")


def test_true_budget_loop(spark):
    pool = vector_pool(spark)
    protocol = loops.Protocol(initial=16, rounds=2, query=8, reservoir=3, reservoir_fraction=1.0, selected=2)
    final, log = loops.true_budget(pool, protocol=protocol)
    assert [x["labeled"] for x in log] == [24, 32]
    # each round pays for its six reservoirs of three rows and at most four batches of candidates
    assert 18 < log[0]["inferences"] < log[1]["inferences"] <= 2 * (18 + 32)
    ranks = [r["rank"] for r in final.collect()]
    assert sorted(ranks) == list(range(len(ranks))) and len(ranks) < 120
    assert all(x["hits"] <= y["hits"] for x, y in zip(log, log[1:]))


@pytest.mark.parametrize("name", ["full_greedy", "uncertainty_sampling", "random", "budgeted_decay_ucb", "budgeted_reliable_random_parts", "legacy", "knn_similarity", "rf_ucb"])
def test_full_pool_loop(spark, name):
    pool = vector_pool(spark)
    final, log = loops.full_pool(pool, name, loops.Protocol(initial=16, rounds=1, query=8))
    assert [x["labeled"] for x in log] == [24]
    rows = final.collect()
    assert sorted(r["rank"] for r in rows) == list(range(120))
    if name != "random":
        means = [np.mean([r["mu"] for r in rows if r["label"] == y]) for y in (0, 1)]
        assert means[1] > means[0]


def test_methods_differ(spark):
    """Exploration and its options change what is chosen."""
    pool = vector_pool(spark).withColumns({"mu": F.element_at("x", 1), "u_epi": F.abs(F.element_at("x", 2)), "u_conf": F.abs(F.element_at("x", 3))})
    labeled = pool.where("part_id < 4 and item_id < 60")
    p = loops.Protocol()

    def utilities(name, r=0):
        found = loops.chosen_partitions(METHODS[name], pool, labeled, r, p, 6).collect()
        return {x["part_id"]: x["utility"] for x in found}

    ucb, no_ucb, elite = utilities("budgeted_reliable"), utilities("budgeted_no_ucb"), utilities("budgeted_elite_decay")
    # partitions without labels have the larger bonus
    assert ucb[4] - no_ucb[4] > ucb[0] - no_ucb[0] > 0
    assert utilities("budgeted_late_exploit", 3) == no_ucb and utilities("budgeted_late_exploit", 1) != no_ucb
    assert utilities("budgeted_decay_ucb", 8)[4] - no_ucb[4] < (ucb[4] - no_ucb[4])
    assert any(elite[k] > utilities("budgeted_decay_ucb")[k] - 1e-9 for k in elite)
    assert utilities("legacy") != utilities("legacy_alloc_u0_mean")


def test_arm_bandit_loop(spark):
    final, arms, log = loops.arm_bandit(vector_pool(spark), protocol=loops.Protocol(initial=16, rounds=2, query=8, selected=2))
    assert [x["labeled"] for x in log] == [24, 32]
    assert arms.agg(F.sum("pull_count")).first()[0] >= 10
    assert sorted(r["rank"] for r in final.collect()) == list(range(final.count()))


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks and groups of any size give the distances of the whole."""
    pool = vector_pool(spark)
    reference = pool.where("item_id % 2 = 0")
    x = {r["item_id"]: np.array(r["x"]) for r in pool.collect()}
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    monkeypatch.setattr(N, "GROUP_ROWS", 11)
    got = {r["item_id"]: r["distance"] for r in V.knn_mean_distance(pool, reference, 3, keys=["target"]).collect()}
    for i, v in x.items():
        assert abs(got[i] - np.mean(sorted(np.linalg.norm(v - x[j]) for j in x if j % 2 == 0)[:3])) < 1e-9
    assert V.knn_mean_distance(pool, pool.where("item_id < 0"), 3).count() == 0
    monkeypatch.setattr(N, "BLOCK_ROWS", 1)  # some blocks are empty
    assert V.knn_mean_distance(pool, reference, 3).count() == 120


def test_range_ranks_by_key(spark):
    rows = spark.createDataFrame([(k, i, float(i % 3)) for k in ("a", "b", None) for i in range(40)], "target string, item_id long, mu double")
    got = {(r["target"], r["item_id"]): r["rank"] for r in R.ranked(rows, F.col("mu").desc()).collect()}
    order = sorted(range(40), key=lambda i: (-(i % 3), i))
    assert len(got) == 120 and all(got[k, i] == place for k in ("a", "b", None) for place, i in enumerate(order))
    cut = {r["target"]: r["cut"] for r in R.quantiles(rows, "mu", 0.9).collect()}
    assert cut == {"a": 2.0, "b": 2.0, None: 2.0}


def test_sampled_tests(spark):
    d = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([0.4, -0.1, 0.3, 0.2, 0.5, -0.2, 0.1, 0.25])] + [("b", 0.0, i) for i in range(30)] + [("b", float("nan"), 99)], "m string, delta double, i int")
    exact = {r["m"]: (r["p"], r["n"]) for r in T.permutation_exact(d, ["m"]).collect()}
    drawn = {r["m"]: r["p"] for r in T.permutation_sampled(d, ["m"], draws=20_000).collect()}
    assert exact["b"] == (1.0, 30) and drawn["b"] == 1.0  # too many deltas to list their signs: drawn
    assert abs(exact["a"][0] - drawn["a"]) < 0.02
    r = {x["m"]: x for x in T.bootstrap_ci(d, ["m"], draws=2000).collect()}["a"]
    assert r["low"] < r["mean"] < r["high"] and abs(r["mean"] - 0.18125) < 1e-9 and 0.2 < r["high"] - r["low"] < 0.5
    z = spark.createDataFrame([(0.0,), (1.959963984540054,), (-1.959963984540054,), (8.0,)], "z double")
    p = [round(x[0], 9) for x in z.select(T.normal_p(F.col("z"))).collect()]
    assert p == [1.0, 0.05, 0.05, 0.0]
    assert [round(x[0], 9) for x in z.select(T.normal_p(F.col("z"), False)).collect()] == [0.5, 0.975, 0.025, 1.0]


def test_models(spark):
    pool = vector_pool(spark)
    scored = V.score_linear(pool, V.logistic_ensemble(pool.where("item_id < 80"), 3))
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("mu").alias("m")).collect()}
    assert means[1] > means[0] + 0.3
    single = V.logistic_ensemble(pool.where("label = 0"), 2)
    assert all(max(map(abs, r["w"])) == 0 for r in single.collect())
    basis = V.truncated_svd(pool, 3)
    assert np.allclose(basis.T @ basis, np.eye(3), atol=1e-9)
    norms = V.project(pool, basis).select(E.norm("z").alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    assert V.kmeans(pool, 4).count() == 4
    assert V.partition_count(100) == 4 and V.partition_count(5_000_000, scale=True) == 2048


def test_streams(spark, tmp_path):
    pool = vector_pool(spark, 40)
    pool.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pool.schema).parquet(str(tmp_path / "in"))
    arms = upkeep.run_to_memory(upkeep.arm_rewards(stream), "arms")
    assert arms.agg(F.sum("pull_count")).first()[0] == 40
    centroids = V.class_centroids(pool.withColumn("class", F.col("label")))
    q = upkeep.assign_stream(spark.readStream.schema(pool.schema).parquet(str(tmp_path / "in")).drop("part_id"), centroids, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
