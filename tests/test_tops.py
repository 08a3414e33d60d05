"""The best rows under all final scores at once, against each score by itself."""

import pytest
from pyspark.sql import functions as F

from budgetsieve.operators import ranking as R
from budgetsieve.operators import tops as T
from budgetsieve.plans import registry
from budgetsieve.plans.catalog import QUERIES
from budgetsieve.sources.pools import Pools


@pytest.mark.parametrize("k", [3, 40])
def test_top_finals(spark, sf_dir, monkeypatch, k):
    pool = Pools(spark, sf_dir).o.withColumn("u_epi", F.col("u_conf"))
    monkeypatch.setattr(T, "SENT_ROWS", 50)  # a target a pass
    methods = ["budgeted_no_ucb_pareto_rrf_balanced", "budgeted_reliable_q90", "budgeted_no_ucb_hit_guard", "budgeted_no_ucb_scaffaug_rerank", "legacy_reliable_combo", "random"]
    got = {}
    for r in registry.top_finals(pool, methods, k).collect():
        got.setdefault(r["method"], set()).add((r["target"], r["item_id"]))
    for m in methods:
        want = R.top_per(registry.final_scores(pool, m), F.col("final").desc(), k)
        assert got[m] == {(r["target"], r["item_id"]) for r in want.select("target", "item_id").collect()}


def test_registry_ranks_no_whole_pool(spark, sf_dir, monkeypatch):
    """No list and no final score is ranked as a whole; before, each fusion ranked every list again."""
    ranked = []
    ranges = R.range_parts
    monkeypatch.setattr(R, "range_parts", lambda *a: ranked.append(a) or ranges(*a))
    assert QUERIES["method_registry"](spark, sf_dir).count() > 0
    assert not ranked
