"""Relational reporting over result tables: paired joins, deltas, pivots, overlaps, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.operators.ranking import joined, range_rank

PAIR = ("target", "seed")


def one_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, with an error at run time where a key has more than one."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__ok", F.assert_true(n == 1, "a key has more than one row")).where(F.col("__ok").isNull()).drop("__ok")


def union_dedup(parts: Sequence[DataFrame], keys: Sequence[str], keep: str = "first") -> DataFrame:
    """All rows of the parts, and of each key the first (or last) by part."""
    both = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_no", F.lit(i))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    order = F.col("source_no").asc() if keep == "first" else F.col("source_no").desc()
    rest = [F.col(c) for c in both.columns if c not in (*keys, "source_no") and c == "item_id"]
    w = Window.partitionBy(*keys).orderBy(order, *rest)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def paired(results: DataFrame, a: str, b: str, values: Sequence[str], keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows of two methods side by side."""
    one = results.where(F.col("method") == a).select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    two = results.where(F.col("method") == b).select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return one.join(two, list(keys))


def deltas(results: DataFrame, reference: str, value: str = "metric", keys: Sequence[str] = PAIR) -> DataFrame:
    """Each method minus the reference method of its key, by one window (no join)."""
    base = F.max(F.when(F.col("method") == reference, F.col(value))).over(Window.partitionBy(*keys))
    return results.withColumn("delta", F.col(value) - base)


def deltas_join(results: DataFrame, reference: str, value: str = "metric", keys: Sequence[str] = PAIR) -> DataFrame:
    """The same by a many-to-one join; methods whose key lacks the reference drop out."""
    base = results.where(F.col("method") == reference).select(*keys, F.col(value).alias("base"))
    return results.join(base, list(keys)).withColumn("delta", F.col(value) - F.col("base"))


def summary(results: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count."""
    out = []
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return results.groupBy(*keys).agg(*out, F.count("*").alias("n"))


def delta_summary(d: DataFrame, keys: Sequence[str] = ("method",), band: float = 1e-12) -> DataFrame:
    """Mean, deviation, median, extremes and signs of deltas; signs have a band of zeros."""
    x = F.col("delta")
    return d.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.median(x).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.count_if(x < -band).alias("negative"), F.count_if(F.abs(x) <= band).alias("zero"), F.count_if(x > band).alias("positive"),
    )


def pivot(results: DataFrame, rows: Sequence[str], columns: str, kinds: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide form with names value__kind; the kinds are stated, so that no job looks for them."""
    return results.groupBy(*rows).agg(*[F.max(F.when(F.col(columns) == k, F.col(v))).alias(f"{v}__{k}") for v in values for k in kinds])


def unpivot(results: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return results.select(*ids, *[F.col(v).cast("double") for v in values]).unpivot(list(ids), list(values), "metric_name", "value")


def overlaps(sets: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Pairs of methods of one key: shared items, Jaccard and share of the smaller set (sets are small top lists)."""
    one = sets.select(*keys, F.col("method").alias("method_a"), F.col("items").alias("a"))
    two = sets.select(*keys, F.col("method").alias("method_b"), F.col("items").alias("b"))
    pairs = one.join(two, list(keys)).where("method_a < method_b")
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return pairs.select(*keys, "method_a", "method_b", shared.cast("long").alias("shared"), (shared / F.greatest(union, F.lit(1))).alias("jaccard"), (shared / F.greatest(F.least(F.size("a"), F.size("b")), F.lit(1))).alias("of_smaller"), (shared == union).alias("identical_sets"))


def amortization(costs: DataFrame, times: Sequence[int] = (1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """Speed-up over N queries when the index is paid once: N * full / (index + N * online)."""
    return costs.withColumn("queries", F.explode(F.array(*[F.lit(t) for t in times]))).withColumn("speedup", F.col("queries") * F.col("full") / (F.col("index") + F.col("queries") * F.col("online")))


def inference_budget(pools: DataFrame, partitions: int, rounds: int, query: int, initial: int) -> DataFrame:
    """What full and budgeted scoring would cost, by formula. pools: keys and n."""
    per = F.least(F.lit(256), F.greatest(F.lit(1), F.bround(F.lit(0.05) * F.col("n") / F.lit(float(partitions))).cast("long")))
    full = F.col("n") * (rounds + 1)
    used = F.lit(initial) + F.lit(partitions) * per + F.lit(rounds * query)
    return pools.withColumns({"full_cost": full, "budget_cost": used}).withColumn("saved", F.lit(1.0) - F.col("budget_cost") / F.col("full_cost"))


def arg_max(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """The whole row with the largest value; ties go to the larger of the other columns."""
    rest = [c for c in df.columns if c != by and c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("r")).select(*keys, "r.*")


def first_seen(log: DataFrame, item: str = "item_id", keys: Sequence[str] = ()) -> DataFrame:
    """The first round in which an item came up: the sets of ever-seen and newly seen items follow."""
    return log.groupBy(*keys, item).agg(F.min("round").alias("first_round"))


def dense_ids(rows: DataFrame, value: str, name: str = "dense_id", order: str = "item_id") -> DataFrame:
    """Numbers a column's values from 0 by their first appearance in the order; nulls share a number as well."""
    first = rows.groupBy(value).agg(F.min(order).alias("__first"))
    numbered = range_rank(first, [F.col("__first").asc()], name).drop("__first")
    return joined(rows, numbered, [value], "inner")


def first_valid(rows: DataFrame, valid: Column, n: int, order: str) -> DataFrame:
    """The first n valid rows in the order; an error if there are fewer."""
    kept = rows.where(valid).orderBy(order).limit(n)
    if (found := kept.count()) < n:
        raise ValueError(f"{found} valid rows of {n}")
    return kept


def status(ratio: Column) -> Column:
    return F.when(ratio >= 0.5, "done").when(ratio > 0, "partial").otherwise("missing")


def to_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table; more rows than the limit are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a printed table")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
