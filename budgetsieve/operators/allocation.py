"""Partition utilities, arm bandits, acquisition scores and batch selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import hash_order, ucb_bonus
from budgetsieve.operators.ranking import KEYS, zscored
from budgetsieve.sources.sinks import small


def topmean(rows: DataFrame, q: float, value: str = "mu", keys: Sequence[str] = (*KEYS, "part_id"), name: str = "topmean") -> DataFrame:
    """Mean of the best max(1, ceil(n q)) values of each key."""
    w = Window.partitionBy(*keys)
    cut = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * F.lit(q)))
    each = rows.withColumn("__in", F.row_number().over(w.orderBy(F.col(value).desc(), "item_id")) <= cut)
    return each.groupBy(*keys).agg(F.avg(F.when(F.col("__in"), F.col(value))).alias(name), F.count("*").alias("n"))


def diversity(rows: DataFrame, keys: Sequence[str] = (*KEYS, "part_id")) -> DataFrame:
    """Distinct groups over rows."""
    return rows.groupBy(*keys).agg((F.count_distinct("scaffold") / F.count("*")).alias("diversity"))


def utility(rows: DataFrame, pulls: DataFrame, round_number: int, explore: str = "ucb", q: float = 0.05, keys: Sequence[str] = (*KEYS, "part_id")) -> DataFrame:
    """Utility of a partition: top mean, a bonus for few pulls, a tenth of its diversity.

    explore: ucb, no_ucb, decay (bonus over the root of the round), late (bonus in the first two rounds).
    pulls: labelled items of each partition.
    """
    both = topmean(rows, q, keys=keys).join(diversity(rows, keys), list(keys)).join(pulls, list(keys), "left")
    bonus = ucb_bonus(F.lit(max(2, round_number + 2)), F.coalesce("pulls", F.lit(0)))
    factor = {"ucb": 1.0, "no_ucb": 0.0, "decay": (round_number + 1) ** -0.5, "late": 1.0 if round_number < 2 else 0.0}[explore]
    return both.withColumn("utility", F.col("topmean") + F.lit(factor) * bonus + F.lit(0.1) * F.col("diversity"))


def utility_legacy(rows: DataFrame, pulls: DataFrame, round_number: int, uncertainty: float = 1.5, keys: Sequence[str] = (*KEYS, "part_id"), scope: Sequence[str] = KEYS) -> DataFrame:
    """Top mean, weighed mean uncertainty, bonus and diversity, minus a quarter of the share of alerts.

    The published risk also averages a z-score over its own scope, which is always zero; it is left out.
    """
    scored = zscored(rows, ["u_epi", "u_conf"], scope).withColumn("__doubt", F.col("z_u_epi") + F.col("z_u_conf"))
    doubt = scored.groupBy(*keys).agg(F.avg("__doubt").alias("doubt"), F.avg("alert").alias("risk"))
    both = topmean(scored, 0.05, keys=keys).join(diversity(scored, keys), list(keys)).join(doubt, list(keys)).join(pulls, list(keys), "left")
    bonus = ucb_bonus(F.lit(max(2, round_number + 2)), F.coalesce("pulls", F.lit(0)))
    return both.withColumn("utility", F.col("topmean") + F.lit(uncertainty) * F.col("doubt") + bonus + F.lit(0.1) * F.col("diversity") - F.lit(0.25) * F.col("risk"))


def select_partitions(utilities: DataFrame, p: int, keys: Sequence[str] = KEYS, score: str = "utility") -> DataFrame:
    """The p best partitions of each key with their rank from 0; ties go to the smaller partition."""
    ranked = utilities.withColumn("part_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "part_id")) - 1)
    return ranked.where(F.col("part_rank") < p)


def bandit_init(labeled: DataFrame, parts: DataFrame, prior_pulls: float = 1.0, prior_rate: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(reward_sum, pull_count) of every arm: a pseudo-pull at the base rate, and one pull where labels are."""
    seen = labeled.groupBy(*keys, "part_id").agg(F.avg("label").alias("rate"))
    base = labeled.groupBy(*keys).agg(F.avg("label").alias("base"))
    out = parts.join(small(base), list(keys), "left").join(seen, [*keys, "part_id"], "left")
    prior = F.coalesce("base", F.lit(prior_rate)) * F.lit(prior_pulls)
    return out.select(*keys, "part_id", (prior + F.coalesce("rate", F.lit(0.0))).alias("reward_sum"), (F.lit(prior_pulls) + F.col("rate").isNotNull().cast("double")).alias("pull_count"))


def bandit_select(arms: DataFrame, utilities: DataFrame, p: int, step: int, coefficient: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The p arms with the highest upper bound; arms never pulled come first, by utility."""
    joined = arms.join(utilities.select(*keys, "part_id", "utility"), [*keys, "part_id"], "left")
    bound = F.col("reward_sum") / F.col("pull_count") + F.lit(coefficient) * F.sqrt(F.lit(2.0) * F.log(F.lit(float(max(2, step)))) / F.greatest(F.col("pull_count"), F.lit(1.0)))
    value = F.when(F.col("pull_count") <= 0, F.lit(1e6) + F.coalesce("utility", F.lit(0.0))).otherwise(bound)
    return select_partitions(joined.withColumn("bound", value), p, keys, "bound")


def bandit_update(arms: DataFrame, selected: DataFrame, batch: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the batch's mean label (0 if empty) and one pull to every selected arm."""
    on = [*keys, "part_id"]
    rewards = batch.groupBy(*on).agg(F.avg("label").alias("reward"))
    pulled = selected.select(*on, F.lit(1.0).alias("pulled")).join(rewards, on, "left")
    out = arms.join(pulled, on, "left")
    return out.select(*on, (F.col("reward_sum") + F.coalesce("reward", F.lit(0.0)) * F.coalesce("pulled", F.lit(0.0))).alias("reward_sum"), (F.col("pull_count") + F.coalesce("pulled", F.lit(0.0))).alias("pull_count"))


ROUTES = ("partitioned", "mean_greedy", "ucb", "random", "uncertainty")


def allocation_routes(reservoir: DataFrame, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, part_id, route, score, part_rank) under five routes from one probe."""
    on = [*keys, "part_id"]
    best = topmean(reservoir, 0.25, keys=on).join(diversity(reservoir, on), on)
    means = reservoir.groupBy(*on).agg(F.avg("mu").alias("mean"))
    doubt = topmean(reservoir, 0.5, "u_conf", on, "doubt").drop("n")
    all_ = best.join(means, on).join(doubt, on)
    dice = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:route:"), F.col("part_id").cast("string"))), 1, 8), 16, 10).cast("double")
    scores = {"partitioned": F.col("topmean") + F.lit(0.1) * F.col("diversity"), "mean_greedy": F.col("mean"), "ucb": F.col("mean") + F.lit(0.5) * F.sqrt(F.lit(2.0) * F.log(F.lit(2.0)) / F.col("n")), "random": dice, "uncertainty": F.col("doubt")}
    long = all_.select(*on, F.explode(F.array(*[F.struct(F.lit(r).alias("route"), scores[r].alias("score")) for r in ROUTES])).alias("r")).select(*on, "r.*")
    return long.withColumn("part_rank", F.row_number().over(Window.partitionBy(*keys, "route").orderBy(F.col("score").desc(), "part_id")) - 1)


def acquired(rows: DataFrame, kind: str = "budgeted", w_conf: float = 0.7, keys: Sequence[str] = KEYS, name: str = "acquisition", seed: int = 0) -> DataFrame:
    """Adds an item's score when a batch is chosen; z-scores are over the candidates at hand."""
    if kind in ("budgeted", "greedy"):
        return rows.withColumn(name, F.col("mu"))
    if kind == "clean":
        return rows.withColumn(name, F.col("mu") - F.lit(0.05) * F.col("alert"))
    if kind == "random":
        return rows.withColumn(name, F.conv(F.substring(hash_order("item_id", seed, "acquire"), 1, 12), 16, 10).cast("double"))
    out = zscored(rows, ["u_epi", "u_conf"], keys)
    doubt = F.col("z_u_epi") + F.col("z_u_conf")
    if kind == "uncertainty":
        score = doubt
    elif kind == "ucb":
        score = F.col("mu") + F.lit(0.5) * F.col("z_u_epi")
    else:  # legacy; the density penalty is the same number as the conformal uncertainty
        score = F.col("mu") + F.col("z_u_epi") - F.lit(w_conf) * F.col("z_u_conf") - F.lit(0.2) * F.col("alert") - F.lit(0.1) * F.col("z_u_conf")
    return out.withColumn(name, score).drop("z_u_epi", "z_u_conf")


def candidate_cap(candidates: DataFrame, others: DataFrame, query: int, multiple: int, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """At most max(query, multiple * query) candidates by hash order; filled from the others where too few."""
    both = candidates.withColumn("filled", F.lit(False)).unionByName(others.withColumn("filled", F.lit(True)))
    cap = max(query, multiple * query)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("filled", hash_order("item_id", seed, "cap"), "item_id"))
    # the cap first, as of each key so many rows at most leave a task
    return both.withColumn("place", first).where(F.col("place") <= cap).where(~F.col("filled") | (F.col("place") <= query))


def select_batch(rows: DataFrame, selected: DataFrame, query: int, score: Column, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The query best rows of the selected partitions; others by hash order where these are too few."""
    marked = rows.join(small(selected.select(*keys, "part_id", F.lit(True).alias("inside"))), [*keys, "part_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.col("inside").desc(), F.when(F.col("inside"), score).desc_nulls_last(), hash_order("item_id", seed, "batch"), "item_id")
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= query)
