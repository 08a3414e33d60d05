"""Rankings, rank fusion and final scores. Ranks are positional from 0; ties go to the smaller item_id.

Targets are few and one may hold most rows, so that nothing here gathers a target in a task: ranks come
from range partitions (:func:`range_rank`), z-scores and quantiles from aggregates that are joined back,
and lists of a fixed length from windows that keep so many rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import EPSILON, col, rrf_term
from budgetsieve.sources.sinks import small, written

KEYS = ("target",)


def joined(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Joins a table with one row a key; null keys are keys as well."""
    if not keys:
        return df.crossJoin(other)
    named = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return df.join(named, on, how).drop(*[f"__{k}" for k in keys])


def rank(score: Column, keys: Sequence[str] = KEYS) -> Column:
    """Position from 0 in the given order, then by item_id; each key's rows meet in one task, so for small keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(score, F.col("item_id"))) - 1


def range_parts(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Rows dealt in ranges of (keys, order) and written in order, with their part and position."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    cut = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__pos", F.monotonically_increasing_id())
    return written(cut, "ranges").withColumn("__part", F.shiftright("__pos", 33))


def range_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """The position from 0 within the keys, for keys too large for one task.

    Rows are dealt in ranges, where their positions are known; these are shifted by the key's rows in
    the parts before (one row a part, and one a key within a part).
    """
    cut = range_parts(df, order, keys)
    sizes = cut.groupBy(*keys, "__part").agg(F.min("__pos").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = small(sizes.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")), "shifts")
    return joined(cut, shifts, [*keys, "__part"], "inner").withColumn(name, F.col("__pos") + F.col("__shift")).drop("__part", "__pos", "__shift")


def running(counts: DataFrame, order: str, amount: str, keys: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Adds the sum of the amounts of a key's rows that come before in the order, in ranges."""
    cut = range_parts(counts, [F.col(order).asc()], keys)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__part").agg(F.sum(amount).alias("__sum"))
    shifts = small(sums.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift")), "shifts")
    within = Window.partitionBy(*keys, "__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    along = cut.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return joined(along, shifts, [*keys, "__part"], "inner").withColumn(name, F.col("__within") + F.col("__shift")).drop("__within", "__shift", "__part", "__pos")


def ranked(df: DataFrame, score: Column, name: str = "rank", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the rank by score, then by item_id."""
    return range_rank(df, [score, F.col("item_id").asc()], name, keys)


def zscored(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, eps: float = EPSILON) -> DataFrame:
    """Adds z_<column>: (x - mean) / (population deviation + eps) within the keys."""
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = joined(df, small(stats, "moments"), keys)
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__mean_{c}")) / (F.col(f"__sd_{c}") + F.lit(eps)) for c in columns})
    return out.drop(*[f"__{n}_{c}" for c in columns for n in ("mean", "sd")])


def with_novelty(df: DataFrame, name: str = "novelty", keys: Sequence[str] = KEYS, group: str = "scaffold") -> DataFrame:
    """Adds one over the number of rows that share the group; groups are counted and joined back."""
    sizes = df.groupBy(*keys, group).agg((F.lit(1.0) / F.count("*")).alias(name))
    return joined(df, sizes, [*keys, group])


#: Weights of cleanliness, confidence and novelty beside the weight 1 of the main score. Fixed values.
RRF_WEIGHTS = {
    "default": (0.18, 0.12, 0.08),
    "clean": (0.35, 0.12, 0.08),
    "novel": (0.18, 0.12, 0.25),
    "balanced": (0.30, 0.12, 0.18),
    "no_conf": (0.18, 0.0, 0.25),
    "mu_only": (0.0, 0.0, 0.0),
    "no_clean": (0.0, 0.12, 0.25),
    "no_novel": (0.18, 0.12, 0.0),
}


def rrf_ranks(pool: DataFrame, keys: Sequence[str] = KEYS, wanted: Sequence[str] = ("clean_rank", "conf_rank", "novel_rank")) -> DataFrame:
    """The ranks that fusion draws on: score, and as wanted few alerts, low uncertainty, novelty.

    All lists are ranked in one pass over (list, value, item) rows and joined to the pool once.
    """
    orders = {"mu_rank": -F.col("mu"), "clean_rank": F.col("alert"), "conf_rank": F.col("u_conf"), "novel_rank": -F.col("novelty")}
    orders = {name: order for name, order in orders.items() if name == "mu_rank" or name in wanted}
    if "novel_rank" in orders:
        pool = with_novelty(pool, keys=keys)
    lists = F.explode(F.array(*[F.struct(F.lit(name).alias("__list"), order.cast("double").alias("__value")) for name, order in orders.items()]))
    rows = pool.select(*keys, "item_id", lists.alias("__l")).select(*keys, "item_id", "__l.*")
    each = range_rank(rows, [F.col("__value").asc(), F.col("item_id").asc()], "__rank", [*keys, "__list"])
    ranks = each.groupBy(*keys, "item_id").agg(*[F.max(F.when(F.col("__list") == name, F.col("__rank"))).alias(name) for name in orders])
    return joined(pool, ranks, [*keys, "item_id"], "inner")


def rrf_score(clean: float, conf: float, novel: float) -> Column:
    score = rrf_term(F.col("mu_rank"), 1.0)
    for weight, name in ((clean, "clean_rank"), (conf, "conf_rank"), (novel, "novel_rank")):
        if weight:
            score = score + rrf_term(F.col(name), weight)
    return score


def fused(pool: DataFrame, weights: str = "default", keys: Sequence[str] = KEYS) -> DataFrame:
    """The pool with its fused score; only ranks with a weight are computed."""
    clean, conf, novel = RRF_WEIGHTS[weights]
    wanted = [name for weight, name in ((clean, "clean_rank"), (conf, "conf_rank"), (novel, "novel_rank")) if weight]
    return rrf_ranks(pool, keys, wanted).withColumn("rrf", rrf_score(clean, conf, novel))


def rrf(pool: DataFrame, weights: str = "default", keys: Sequence[str] = KEYS) -> DataFrame:
    """The pool with its fused score and final rank."""
    return ranked(fused(pool, weights, keys), F.col("rrf").desc(), "rank", keys)


def scaffold_repeat(pool: DataFrame, score: str = "mu", penalty: float = 0.025, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lowers a score by the logarithm of how many better items share its group."""
    earlier = F.row_number().over(Window.partitionBy(*keys, "scaffold").orderBy(F.col(score).desc(), "item_id")) - 1
    return pool.withColumn("final", F.col(score) - F.lit(penalty) * F.log1p(earlier.cast("double")))


#: Rows of a key from which a quantile is searched between bounds, the share on each side of it that these leave
#: (over the error of the sketch that gives them), and values between bounds up to which a key's are summed in a task.
ROUGH, MARGIN, ACCURACY, IN_TASK = 50_000, 3e-4, 10_000, 1_000_000


def quantiles(pool: DataFrame, value: str, q: float, keys: Sequence[str] = KEYS, name: str = "cut", place: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, name): linearly interpolated quantiles, from the order statistics on both sides of the place.

    place: the place from 0 in the order by the number of rows, if it isn't (n - 1) * q but next to it.

    A sketch gives bounds around the place, rows under them are counted, and only the distinct values between
    them are counted and summed up in order: by a window where they are few, in ranges otherwise. The pool is
    neither sorted nor written.
    """
    values = pool.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sketch = F.percentile_approx("__v", [max(0.0, q - MARGIN), min(1.0, q + MARGIN)], ACCURACY)
    sizes = values.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), sketch.alias("__b"))
    large = F.col("__n") > ROUGH
    at = place(F.col("__n")) if place else (F.col("__n") - 1) * F.lit(q)
    low, high = F.when(large, F.get("__b", F.lit(0))).otherwise(F.col("__least")), F.when(large, F.get("__b", F.lit(1))).otherwise(F.col("__most"))
    bounds = small(sizes.select(*keys, at.cast("double").alias("__at"), low.alias("__low"), high.alias("__high")), "bounds")
    near = joined(values, bounds, keys, "inner").where(F.col("__v") <= F.col("__high"))
    inside = F.when(F.col("__v") >= F.col("__low"), F.col("__v"))  # null: counted as a whole
    held = near.groupBy(*keys, inside.alias("__v")).agg(F.count("*").alias("__n"), F.first("__at").alias("__at"))
    most = (bounds.agg(F.max("__at")).first()[0] or 0) * 4 * MARGIN
    if most <= IN_TASK:
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()))
        summed = held.select(*keys, "__v", "__at", upto.alias("__upto"))
    else:
        summed = running(held, "__v", "__n", keys, "__before").select(*keys, "__v", "__at", (F.col("__before") + F.col("__n")).alias("__upto"))
    at_least = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    ends = summed.where(F.col("__v").isNotNull()).groupBy(*keys).agg(at_least(F.floor("__at")).alias("low"), at_least(F.ceil("__at")).alias("high"), F.first("__at").alias("at"))
    return ends.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias(name))


def quantile_of(pool: DataFrame, value: str, q: float, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The pool with a linearly interpolated quantile of its keys."""
    return joined(pool, small(quantiles(pool, value, q, keys, name), "quantiles"), keys)


# The weights of the final scores below are the published ones. Fixed values.


def risk_constrained(pool: DataFrame, q: float = 0.75, keys: Sequence[str] = KEYS, alert: float = 0.1, novel: float = 0.05) -> DataFrame:
    """Score with novelty and alerts; items above the uncertainty quantile fall by one."""
    out = zscored(with_novelty(quantile_of(pool, "u_conf", q, "cut", keys), "nov", keys), ["nov"], keys)
    base = F.col("mu") + F.lit(novel) * F.col("z_nov") - F.lit(alert) * F.col("alert")
    return out.withColumn("base", base).withColumn("final", F.when(F.col("u_conf") <= F.col("cut"), F.col("base")).otherwise(F.col("base") - 1.0))


def soft_reliable(pool: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    out = zscored(with_novelty(pool, "nov", keys), ["nov", "u_conf"], keys)
    return out.withColumn("final", F.col("mu") + F.lit(0.02) * F.col("z_nov") - F.lit(0.05) * F.col("alert") - F.lit(0.03) * F.col("z_u_conf"))


def hit_guard(pool: DataFrame, q: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """The best tenth keeps its score almost untouched; the rest is weighed."""
    out = zscored(with_novelty(quantile_of(pool, "mu", q, "cut", keys), "nov", keys), ["nov", "u_conf"], keys)
    rest = F.col("mu") + F.lit(0.03) * F.col("z_nov") - F.lit(0.08) * F.col("alert") - F.lit(0.02) * F.col("z_u_conf")
    return out.withColumn("final", F.when(F.col("mu") >= F.col("cut"), F.col("mu") - F.lit(0.01) * F.col("alert")).otherwise(rest))


def top_k(pool: DataFrame, score: Column | str, k: int) -> DataFrame:
    """The k best rows of the whole pool."""
    return pool.orderBy(col(score).desc(), "item_id").limit(k)


def top_per(pool: DataFrame, score: Column, k: Column | int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k best rows of each key (a group limit before the shuffle where k is fixed)."""
    ranked = pool.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(score, F.col("item_id"))))
    return ranked.where(F.col("__place") <= k).drop("__place")


def rrf_weight_grid(pool: DataFrame, grid: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hits in the top k for each pair of weights (w_clean, w_novel); ranks are computed once.

    The grid is a small fixed table; of each cell every task keeps k rows before the shuffle.
    """
    each = written(rrf_ranks(pool, keys, ("clean_rank", "novel_rank")), "ranks").crossJoin(F.broadcast(grid))
    score = F.lit(1.0) / (F.lit(60.0) + F.col("mu_rank")) + F.col("w_clean") / (F.lit(60.0) + F.col("clean_rank")) + F.col("w_novel") / (F.lit(60.0) + F.col("novel_rank"))
    cells = [*keys, "w_clean", "w_novel"]
    return top_per(each.withColumn("rrf", score), F.col("rrf").desc(), k, cells).groupBy(*cells).agg(F.sum("label").alias("hits"), F.avg("alert").alias("alerts"))
