"""A seeded mixture pool of any size: one item a number of a given table, with correlated label columns.

Tables that only depend on parameters (centres, strengths, weights: partitions x features or targets) are drawn
from a seed. What differs from item to item is counted, not drawn: a digest of (seed, purpose, number) gives a
uniform, and two of them a normal number, so that an item is the same in any task and any engine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetsieve.functions.expr import dot, let
from budgetsieve.operators.ranking import quantile_of
from budgetsieve.sources.sinks import written


@dataclass(frozen=True)
class Mixture:
    """Parameters of a pool, and its tables."""

    targets: int = 4
    partitions: int = 64
    features: int = 8
    scaffolds: int = 500
    seed: int = 0
    share: float = 0.955

    def tables(self) -> list[tuple[int, float, list[float], list[float], int]]:
        """A row a partition: its number, cumulative share, centre, strength by target and first group."""
        rng = np.random.default_rng(self.seed)
        centres = rng.normal(size=(self.partitions, self.features))
        strength = rng.beta(0.8, 8.0, size=(self.targets, self.partitions))
        upto = np.cumsum(rng.dirichlet(np.full(self.partitions, 0.8)))
        first = rng.integers(0, self.scaffolds, size=self.partitions)
        return [(p, float(upto[p]), centres[p].tolist(), strength[:, p].tolist(), int(first[p])) for p in range(self.partitions)]

    def weights(self) -> list[list[float]]:
        """Weights of the features by target."""
        return np.random.default_rng(self.seed + 1).normal(size=(self.targets, self.features)).tolist()


def uniform(item: Column, seed: int, purpose: str | Column) -> Column:
    """A number from 0 to 1, neither included, from a digest."""
    name = F.concat(F.lit(f"{seed}:"), F.lit(purpose) if isinstance(purpose, str) else purpose, F.lit(":"), item.cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def normal(item: Column, seed: int, purpose: str | Column) -> Column:
    """A standard normal number from two uniform ones."""
    of = lambda x: F.concat(F.lit(purpose) if isinstance(purpose, str) else purpose, F.lit(x))
    return F.sqrt(F.lit(-2.0) * F.log(uniform(item, seed, of("a")))) * F.cos(F.lit(2 * math.pi) * uniform(item, seed, of("b")))


def mixture_pool(numbers: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """target, item_id, label, logit, alert, scaffold, part_id and x for each number (item_id) and target.

    Items stand around their partition's centre and have unit length; an item's logits share its partition's
    strength and its alert, and the best of each target are labelled.
    """
    spark, item = numbers.sparkSession, F.col("item_id")
    parts = spark.createDataFrame([(p, c, s, f) for p, _, c, s, f in m.tables()], "part_id int, centre array<double>, strength array<double>, first long")
    upto = F.array(*[F.lit(u) for _, u, *_ in m.tables()[:-1]])
    part = let(uniform(item, m.seed, "part"), lambda u: F.size(F.filter(upto, lambda c: c <= u)))
    dealt = numbers.select("item_id", part.alias("part_id"))
    dealt = dealt.join(F.broadcast(parts), "part_id")  # as many rows as partitions, a parameter
    noise = F.transform("centre", lambda c, i: c + F.lit(0.7) * normal(F.col("item_id"), m.seed, F.concat(F.lit("x"), i.cast("string"))))
    x = dealt.withColumn("x", let(noise, lambda r: let(F.greatest(F.sqrt(dot(r, r)), F.lit(1e-6)), lambda n: F.transform(r, lambda v: v / n))))
    risk = F.lit(0.8) * F.element_at("x", 1) - F.lit(0.5) * F.element_at("x", 2) + F.lit(0.7) * normal(item, m.seed, "risk")
    alert = (F.lit(1.0) / (F.lit(1.0) + F.exp(-risk)) > 0.72).cast("int")
    scaffold = (F.col("first") + F.floor(F.lit(17.0) * uniform(item, m.seed, "group")).cast("long")) % m.scaffolds
    items = x.select("item_id", "part_id", scaffold.alias("scaffold"), alert.alias("alert"), "x", "strength")
    weights = F.array(*[F.array(*[F.lit(v) for v in w]) for w in m.weights()])
    each = items.select("*", F.posexplode(weights).alias("target", "w"))
    noisy = F.lit(0.35) * normal(item, m.seed, F.concat(F.lit("y"), F.col("target").cast("string")))
    logit = dot("x", "w") + F.lit(3.8) * F.get("strength", F.col("target")) - F.lit(0.65) * F.col("alert") + noisy
    scored = written(each.select("target", "item_id", logit.alias("logit"), "alert", "scaffold", "part_id", "x"), "mixture")
    cut = quantile_of(scored, "logit", m.share, "cut")
    return cut.select("target", "item_id", (F.col("logit") >= F.col("cut")).cast("int").alias("label"), "logit", "alert", "scaffold", "part_id", "x")


def mixture_sql(numbers: str, m: Mixture = Mixture()) -> str:
    """The same pool in SQL (without x), over a table that has item_id."""
    u = lambda purpose: f"((('0x' || substr(md5('{m.seed}:' || {purpose} || ':' || item_id), 1, 12))::BIGINT)::DOUBLE + 0.5e0) / {float(1 << 48)!r}::DOUBLE"
    n = lambda purpose: f"(sqrt(-2.0e0 * ln({u(purpose + ' || ' + chr(39) + 'a' + chr(39))})) * cos({2 * math.pi!r}::DOUBLE * {u(purpose + ' || ' + chr(39) + 'b' + chr(39))}))"
    parts = ", ".join(f"({p}, {c}::DOUBLE[], {s}::DOUBLE[], {f})" for p, _, c, s, f in m.tables())
    upto = [x for _, x, *_ in m.tables()[:-1]]
    targets = ", ".join(f"({t}, {w}::DOUBLE[])" for t, w in enumerate(m.weights()))
    add = "list_reduce({}, lambda a, b: a + b)"
    return f"""
parts(part_id, centre, strength, first) AS (VALUES {parts}), weights(target, w) AS (VALUES {targets}),
dealt AS (SELECT item_id, len(list_filter({upto}::DOUBLE[], lambda c: c <= u)) AS part_id FROM (SELECT item_id, {u("'part'")} AS u FROM {numbers})),
raw AS (SELECT item_id, part_id, strength, first, list_transform(range({m.features}), lambda i: centre[i + 1] + 0.7e0 * {n("'x' || i")}) AS r FROM dealt JOIN parts USING (part_id)),
placed AS (SELECT *, list_transform(r, lambda v: v / greatest(sqrt({add.format("list_transform(r, lambda y: y * y)")}), 1e-6)) AS x FROM raw),
items AS (SELECT item_id, part_id::INT AS part_id, strength, x, (1 / (1 + exp(-(0.8e0 * x[1] - 0.5e0 * x[2] + 0.7e0 * {n("'risk'")}))) > 0.72e0)::INT AS alert, ((first + floor(17.0e0 * {u("'group'")})::BIGINT) % {m.scaffolds})::BIGINT AS scaffold FROM placed),
scored AS (SELECT target, item_id, part_id, scaffold, alert, {add.format("list_transform(list_zip(x, w), lambda t: t[1] * t[2])")} + 3.8e0 * strength[target + 1] - 0.65e0 * alert + 0.35e0 * {n("'y' || target")} AS logit FROM items, weights),
mixture AS (SELECT target::INT AS target, item_id, (logit >= quantile_cont(logit, {m.share!r}::DOUBLE) OVER (PARTITION BY target))::INT AS label, logit, alert, scaffold, part_id FROM scored)"""
