"""Queries take their sizes from the table and run the operators' production parameters."""

from pyspark.sql import functions as F

from budgetsieve.operators import stats, vectors
from budgetsieve.plans import catalog_items
from budgetsieve.plans.catalog import QUERIES
from budgetsieve.sources.pools import Pools


def test_loops_take_every_class(spark, sf_dir):
    pools = Pools(spark, sf_dir)
    wanted = {r[0] for r in pools.v.select("class").distinct().collect()}
    found = catalog_items._vector_pool(pools).groupBy("target").agg(F.count("*").alias("n")).collect()
    assert len(wanted) > 2 and {r["target"] for r in found} == wanted
    assert {r["n"] for r in found} == {pools.v.count()}


def test_parameters(spark, sf_dir, monkeypatch):
    seen = {}
    kmeans = vectors.kmeans
    monkeypatch.setattr(vectors, "kmeans", lambda pool, k, **kw: seen.update(k=k) or kmeans(pool, k, **kw))
    QUERIES["kmeans_partitions"](spark, sf_dir)
    assert seen["k"] == vectors.partition_count(Pools(spark, sf_dir).v.count())
    for name in ("bootstrap_ci", "permutation_sampled"):
        operator = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *a, operator=operator, name=name, **kw: seen.update({name: kw}) or operator(*a, **kw))
        QUERIES[name](spark, sf_dir)
        assert "draws" not in seen[name]
