"""Ranking, calibration, conformal and diversity metrics over (keys..., rank, label, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import clip, half_even, hash_order, l2_normalize
from budgetsieve.operators import ranking as R
from budgetsieve.operators.ranking import KEYS, joined, quantile_of, top_per
from budgetsieve.sources.sinks import small


def ranked(pool: DataFrame, score: str = "mu", keys: Sequence[str] = KEYS) -> DataFrame:
    return R.ranked(pool, F.col(score).desc(), "rank", keys)


def at_k(rows: DataFrame, ks: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Hits, recall, distinct groups and shares without alert in the top k, in long form."""
    wide = rows.groupBy(*keys).agg(
        F.sum("label").alias("positives"),
        *[F.sum(F.when(F.col("rank") < k, F.col("label")).otherwise(0)).alias(f"hit{k}") for k in ks],
        *[F.count_distinct(F.when(F.col("rank") < k, F.col("scaffold"))).alias(f"groups{k}") for k in ks],
        *[F.avg(F.when(F.col("rank") < k, F.col("alert"))).alias(f"alerts{k}") for k in ks],
    )
    cells = [F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").alias("hits"), F.col(f"groups{k}").alias("groups"), (F.lit(1.0) - F.col(f"alerts{k}")).alias("alert_free")) for k in ks]
    out = wide.select(*keys, "positives", F.explode(F.array(*cells)).alias("c")).select(*keys, "positives", "c.*")
    return out.withColumn("recall", F.col("hits") / F.greatest(F.col("positives"), F.lit(1)))


def enrichment(rows: DataFrame, fraction: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rate of labels in the top fraction over the base rate; halves round to even."""
    sized = small(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("label").alias("base")))
    cut = F.greatest(F.lit(1), half_even(F.col("n") * F.lit(fraction)))
    top = joined(rows, sized, keys, "inner").where(F.col("rank") < cut)
    return top.groupBy(*keys).agg((F.avg("label") / F.greatest(F.first("base"), F.lit(1e-12))).alias("enrichment"))


def bedroc(rows: DataFrame, alpha: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Boltzmann-enhanced discrimination, in [0, 1]; null without labels."""
    sized = small(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("a")))
    each = joined(rows, sized, keys, "inner")
    s = each.groupBy(*keys).agg(F.sum(F.when(F.col("label") == 1, F.exp(-F.lit(alpha) * (F.col("rank") + 1) / F.col("n"))).otherwise(0.0)).alias("s"), F.first("n").alias("n"), F.first("a").alias("a"))
    return s.select(*keys, bedroc_of(F.col("s"), F.col("n"), F.col("a"), alpha).alias("bedroc"))


def bedroc_of(s: Column, n: Column, a: Column, alpha: float = 20.0) -> Column:
    """BEDROC from s, the sum of exp(-alpha * place / n) over the a labels of n rows, places from 1."""
    ratio = a / n
    rie = s / (ratio * (F.lit(1.0) - F.exp(F.lit(-alpha))) / (F.exp(F.lit(alpha) / n) - F.lit(1.0)))
    low = (F.lit(1.0) - F.exp(F.lit(alpha) * ratio)) / (ratio * (F.lit(1.0) - F.exp(F.lit(alpha))))
    high = (F.lit(1.0) - F.exp(F.lit(-alpha) * ratio)) / (ratio * (F.lit(1.0) - F.exp(F.lit(-alpha))))
    return F.when(a > 0, F.when(a == n, F.lit(1.0)).otherwise(clip((rie - low) / (high - low), 0.0, 1.0)))


def trapezoid(points: DataFrame, x: str, y: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area under (x, y) by keys, with the last x and y."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = (F.col(y) + F.lag(y).over(w)) / F.lit(2.0) * (F.col(x) - F.lag(x).over(w))
    return points.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("area"), F.max(x).alias("last_x"), F.max_by(y, x).alias("last_y"))


def cumulative(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running sums of hits and queries over rounds."""
    w = Window.partitionBy(*keys).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({"cumulative_hits": F.sum("hits").over(w), "cumulative_queried": F.sum("queried").over(w)})


def aubc_legacy(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shape of the recovery curve, normalised by its own last hits."""
    area = trapezoid(cumulative(log, keys).withColumn("x", F.col("round").cast("double")).withColumn("y", F.col("cumulative_hits").cast("double")), "x", "y", keys)
    return area.select(*keys, (F.col("area") / (F.col("last_x") * F.greatest(F.col("last_y"), F.lit(1.0)))).alias("aubc"))


def aubc_recall(log: DataFrame, initial_hits: int, positives: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area under recall, from the initial hits at 0 on; positives has one row (keys, positives) a key."""
    points = cumulative(log, keys).select(*keys, F.col("round").cast("double").alias("x"), (F.col("cumulative_hits") + initial_hits).cast("double").alias("y"))
    start = log.select(*keys).distinct().select(*keys, F.lit(0.0).alias("x"), F.lit(float(initial_hits)).alias("y"))
    area = trapezoid(points.unionByName(start), "x", "y", keys).join(positives, list(keys))
    return area.select(*keys, (F.col("area") / (F.col("last_x") * F.greatest(F.lit(1), F.col("positives")))).alias("aubc"))


def ece(rows: DataFrame, p: str = "mu", bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected calibration error over bins [low, high); a prediction of exactly 1 is in no bin."""
    inside = (F.col(p) >= 0) & (F.col(p) < 1)
    bin_ = F.when(inside, F.floor(F.col(p) * bins)).otherwise(-1)
    each = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("label") - F.avg(p)).alias("gap"))
    return each.groupBy(*keys).agg((F.sum(F.when(F.col("bin") >= 0, F.col("n") * F.col("gap"))) / F.sum("n")).alias("ece"))


def brier(p: str = "mu") -> Column:
    return F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label")))


def nll(p: str = "mu", eps: float = 1e-7) -> Column:
    c = clip(p, eps, 1 - eps)
    return -F.avg(F.col("label") * F.log(c) + (F.lit(1.0) - F.col("label")) * F.log(F.lit(1.0) - c))


def reliability(rows: DataFrame, p: str = "mu", bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins with count, mean prediction, rate and binomial error; the top bin is closed."""
    b = F.least(F.floor(clip(p, 0.0, 1.0) * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg("label").alias("rate"))
    return out.withColumn("se", F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / F.col("n")))


def conformal_threshold(rows: DataFrame, alpha: float = 0.1, p: str = "mu", keys: Sequence[str] = KEYS) -> DataFrame:
    """The residual at place ceil((n + 1)(1 - alpha)), at most the last; found by counts, without a sort."""
    residual = rows.select(*keys, F.abs(F.col("label") - F.col(p)).cast("double").alias("residual"))
    place = lambda n: F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * F.lit(1 - alpha)).cast("long"))) - 1
    return R.quantiles(residual, "residual", 1 - alpha, keys, "threshold", place)


def conformal_coverage(rows: DataFrame, thresholds: DataFrame, p: str = "mu", keys: Sequence[str] = KEYS) -> DataFrame:
    each = joined(rows, small(thresholds), keys, "inner")
    return each.groupBy(*keys).agg(F.avg((F.abs(F.col("label") - F.col(p)) <= F.col("threshold")).cast("double")).alias("coverage"))


def risk_coverage(rows: DataFrame, p: str = "mu", u: str = "u_conf", keys: Sequence[str] = KEYS) -> DataFrame:
    """Area under mean residual against coverage, from the most certain on, over twenty coverages.

    Residuals are summed along ranges of the order; a range's sums start from those of the ranges before.
    """
    residual = rows.select(*keys, "item_id", u, F.abs(F.col("label") - F.col(p)).alias("residual"))
    parts = R.range_parts(residual, [F.col(u).asc(), F.col("item_id").asc()], keys)
    each = parts.groupBy(*keys, "__part").agg(F.count("*").alias("n"), F.sum("residual").alias("sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = small(each.select(*keys, "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("sum_before")))
    within = Window.partitionBy(*keys, "__part").orderBy("__pos")
    along = parts.withColumns({"place": F.row_number().over(within), "sum": F.sum("residual").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    running = joined(along, shifts, [*keys, "__part"], "inner").select(*keys, (F.col("place") + F.col("n_before")).alias("place"), ((F.col("sum") + F.col("sum_before")) / (F.col("place") + F.col("n_before"))).alias("risk"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(19)))
    points = parts.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n", grid.alias("i")).withColumn("c", F.lit(0.05) + F.lit(0.95) * F.col("i") / F.lit(19))
    points = small(points.select(*keys, F.ceil(F.col("c") * F.col("n")).cast("long").alias("place"), "c"))  # twenty rows a key
    return trapezoid(joined(running, points, [*keys, "place"], "inner"), "c", "risk", keys).select(*keys, (F.col("area") / F.lit(0.95)).alias("aurc"))


def stratified_split(rows: DataFrame, fraction: float = 0.2, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Marks a calibration part in each class, leaving at least one row; classes of one row stay out."""
    w = Window.partitionBy(*keys, "label")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(hash_order("item_id", seed, "split"), "item_id"))
    want = F.least(n - 1, F.greatest(F.lit(1), half_even(n * F.lit(fraction))))
    return rows.withColumn("calibration", (place <= want) & (n >= 2))


def false_confidence_gap(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """In the best tenth: hit rate of the less uncertain half minus that of the rest."""
    top = quantile_of(rows, "mu", 0.9, "q90", keys).where(F.col("mu") >= F.col("q90"))
    halves = quantile_of(top, "u_conf", 0.5, "mid", keys)
    low = F.col("u_conf") <= F.col("mid")
    return halves.groupBy(*keys).agg((F.avg(F.when(low, F.col("label"))) - F.avg(F.when(~low, F.col("label")))).alias("gap"))


def mean_pairwise_cosine(rows: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Mean cosine distance over all pairs of the top k, from the sum of unit vectors: no pairs are made."""
    unit = top_per(rows, F.col("score").desc(), k, keys).select(*keys, "item_id", F.posexplode(l2_normalize("x")).alias("dim", "u"))
    by_dim = unit.groupBy(*keys, "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("n"))
    total = by_dim.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return total.select(*keys, F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.lit(1.0) - (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("distance"))


def mean_pairwise_tanimoto(rows: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Mean Jaccard distance of on-bits over the pairs of the top k (k is small and fixed); 1 if fewer than two."""
    top = top_per(rows, F.col("score").desc(), k, keys).select(*keys, "item_id", "bits")
    one, two = top.select(*keys, F.col("item_id").alias("a"), F.col("bits").alias("ba")), top.select(*keys, F.col("item_id").alias("b"), F.col("bits").alias("bb"))
    pairs = one.join(two, list(keys)).where("a < b")
    union = F.size(F.array_union("ba", "bb"))
    distance = F.lit(1.0) - F.when(union > 0, F.size(F.array_intersect("ba", "bb")) / union).otherwise(F.lit(0.0))
    found = pairs.groupBy(*keys).agg(F.avg(distance).alias("distance"))
    return top.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("distance", F.lit(1.0)).alias("distance"))
