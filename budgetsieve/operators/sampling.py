"""Reproducible samples by hash order: reservoirs, initial labels, quotas, budget fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import hash_order
from budgetsieve.operators.ranking import KEYS, range_rank
from budgetsieve.sources.sinks import small


def placed(df: DataFrame, keys: Sequence[str], seed: int, purpose: str, name: str = "place") -> DataFrame:
    """Each row's position from 1 in the hash order of its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order("item_id", seed, purpose), "item_id")))


def reservoir_fixed(pool: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = (*KEYS, "part_id")) -> DataFrame:
    """At most n rows of each partition."""
    return placed(pool, keys, seed, "reservoir").where(F.col("place") <= n)


def reservoir_fraction(pool: DataFrame, fraction: float, cap: int, seed: int = 0, keys: Sequence[str] = (*KEYS, "part_id")) -> DataFrame:
    """A share of each partition, rounded up, at least one row and at most cap."""
    sized = placed(pool, keys, seed, "reservoir").withColumn("size", F.count("*").over(Window.partitionBy(*keys)))
    want = F.least(F.col("size"), F.lit(cap), F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("size"))))
    return sized.where(F.col("place") <= want)


def initial_labels(pool: DataFrame, size: int, share: int = 32, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """size // share positives (at least one), the rest negatives."""
    positives = max(1, size // share)
    each = placed(pool, [*keys, "label"], seed, "initial").where(F.col("place") <= max(positives, size - positives))  # so many leave a task
    return each.where(F.when(F.col("label") == 1, F.col("place") <= positives).otherwise(F.col("place") <= size - positives))


def nested_prefix(pool: DataFrame, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """Nested samples: (size, item_id), each a prefix of one hash order."""
    most = pool.select("item_id").orderBy(hash_order("item_id", seed, "prefix"), "item_id").limit(max(sizes))
    # bounded by the largest size
    rank = F.row_number().over(Window.orderBy(hash_order("item_id", seed, "prefix"), "item_id"))
    return most.withColumn("prefix_rank", rank).select("item_id", "prefix_rank", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where(F.col("prefix_rank") <= F.col("size"))


def quota_fill(pool: DataFrame, quota: Column | int, total: int, score: str = "mu", keys: Sequence[str] = KEYS, by_id: bool = False) -> DataFrame:
    """The best of each partition up to a quota, then the best of the rest, to a total.

    Where the quotas alone exceed the total the lowest scores go, or with ``by_id`` the largest ids.
    """
    each = pool.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "part_id").orderBy(F.col(score).desc(), "item_id")))
    each = each.withColumn("filled", F.col("place") > quota)
    first = [F.when(~F.col("filled"), F.col("item_id"))] if by_id else []
    order = Window.partitionBy(*keys).orderBy("filled", *first, F.col(score).desc(), "item_id")
    return each.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= total)


def budget_fill(pool: DataFrame, part_ranks: DataFrame, budget: Column | int, reservoir: int, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reservoir rows first, then partitions in order of rank, until the budget is used."""
    rows = placed(pool, [*keys, "part_id"], seed, "reservoir").withColumn("probed", F.col("place") <= reservoir)
    ranked = rows.join(small(part_ranks), [*keys, "part_id"])
    order = Window.partitionBy(*keys).orderBy(F.col("probed").desc(), F.when(F.col("probed"), F.lit(0)).otherwise(F.col("part_rank")), hash_order("item_id", seed, "fill"), "item_id")
    return ranked.withColumn("spent", F.row_number().over(order)).where(F.col("spent") <= budget)


def upsample(pool: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """size rows drawn with replacement by hash; rows are numbered in range partitions, not in one task."""
    n = pool.count()
    numbered = range_rank(pool, [F.col("item_id")], "__i")
    draws = pool.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(hash_order("id", seed, "draw"), 1, 15), 16, 10).cast("long"), F.lit(n)).alias("__i"))
    return draws.join(numbered, "__i").drop("__i")
