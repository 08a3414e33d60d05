"""Vector operators: nearest neighbours, centroids, projections, spread."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.functions.expr import dot, sigmoid, squared_distance
from budgetsieve.operators.landmarks import gram_times, leading
from budgetsieve.operators.lists import nearest, with_nearest
from budgetsieve.operators.trees import extra_trees, forest, score_trees
from budgetsieve.sources.sinks import small, written

def _mean(values: str):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def knn_mean_distance(pool: DataFrame, reference: DataFrame, k: int, name: str = "distance", keys: Sequence[str] = ()) -> DataFrame:
    """Mean Euclidean distance of each row's x to its k nearest reference vectors."""
    return nearest(pool, reference, k, keys, "__near").select(*keys, "item_id", _mean("__near").alias(name))


def knn_margin(pool: DataFrame, labeled: DataFrame, k: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean distance to the k nearest negatives minus that to the k nearest positives."""
    far = knn_mean_distance(pool, labeled.where("label = 0"), k, "to_negative", keys)
    near = knn_mean_distance(pool, labeled.where("label = 1"), k, "to_positive", keys)
    return near.join(far, [*keys, "item_id"]).withColumn("margin", F.col("to_negative") - F.col("to_positive"))


def class_centroids(pool: DataFrame, group: str = "class") -> DataFrame:
    """Mean vector of each group: one partial sum a task, group and dimension."""
    each = pool.select(group, F.posexplode("x").alias("dim", "value"))
    means = each.groupBy(group, "dim").agg(F.avg("value").alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(pool: DataFrame, centroids: DataFrame, group: str = "class", name: str = "part_id") -> DataFrame:
    """Assigns each row to its nearest centroid (a fixed small table); ties go to the smaller group."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "centroid"))).alias("table"))
    each = pool.crossJoin(F.broadcast(table))
    d = F.transform("table", lambda c: F.struct(squared_distance(F.col("x"), c["centroid"]).alias("d"), c["g"].alias("g")))
    return each.withColumn("__best", F.array_min(d)).withColumn(name, F.col("__best")["g"]).drop("table", "__best")


def partition_spread(pool: DataFrame, part: Sequence[str] = ("part_id",)) -> DataFrame:
    """Mean over dimensions of the population deviation within each partition."""
    each = pool.select(*part, F.posexplode("x").alias("dim", "value"))
    return each.groupBy(*part, "dim").agg(F.stddev_pop("value").alias("s")).groupBy(*part).agg(F.avg("s").alias("spread"))


def hash_table(bits: int, dims: int) -> list[tuple[int, int, int]]:
    """(bit, dimension, sign) by a multiplicative hash of the bit."""
    out = []
    for b in range(bits):
        h = (b * 2654435761 + 104729) % (1 << 32)
        out.append((b, h % dims, 1 if (h >> 16) & 1 else -1))
    return out


def signed_hash_projection(rows: DataFrame, bits: int = 2048, dims: int = 96) -> DataFrame:
    """Long form (item_id, dim, value) of the L2-normalised signed sums of on-bits, for dimensions with bits.

    One row in, its dimensions out: a batch is one product with the fixed table, and nothing is shuffled.
    """
    table = np.zeros((bits, dims), np.float64)
    for b, d, sign in hash_table(bits, dims):
        table[b, d] = sign

    @F.pandas_udf("array<double>")
    def times(on: pd.Series) -> pd.Series:
        out = []
        for x in on:
            picked = table[np.asarray(x, np.int64)]
            sums = picked.sum(axis=0)
            out.append(np.where((picked != 0).any(axis=0), sums / max(float(np.sqrt((sums * sums).sum())), 1e-12), np.nan))
        return pd.Series(out)

    return rows.select("item_id", F.posexplode(times("bits")).alias("dim", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


def shingle_bits(rows: DataFrame, text: str = "text", bits: int = 2048) -> DataFrame:
    """Distinct hashed words of a text as on-bits: a stand-in for a structural fingerprint."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), " "))
    return rows.withColumn("bits", F.array_distinct(F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % bits).cast("int"))))


def truncated_svd(pool: DataFrame, k: int) -> np.ndarray:
    """The k leading right singular vectors of x (not centred), columns; signs make the largest entry positive."""
    dims = pool.select(F.size("x")).first()[0]
    return leading(gram_times(pool, "x", dims), dims, k)


def project(pool: DataFrame, basis: np.ndarray, name: str = "z") -> DataFrame:
    """Multiplies x by a fixed basis and normalises, in batches."""

    @F.pandas_udf("array<double>")
    def times(x: pd.Series) -> pd.Series:
        z = np.array(x.tolist(), np.float64) @ basis
        return pd.Series(list(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)))

    return pool.withColumn(name, times("x"))


def logistic_ensemble(labeled: DataFrame, members: int = 5, seed: int = 0, penalty: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients (keys..., member, w, b) of balanced logistic regressions on per-class resamples.

    The labelled set is bounded by the query budget; each member is fitted in one task by
    Newton steps on 1/2 |w|^2 + penalty * sum of weighted losses, intercept unpenalised. With one class
    only, a member has w = 0 and the log-odds of the (clipped) rate.
    """
    spread = labeled.select(*keys, "item_id", "label", "x")
    if not keys:  # a task a member; of several keys a task fits all members, which reads their rows once
        spread = spread.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        y = pdf["label"].to_numpy(np.float64)
        x = np.array(pdf["x"].tolist(), np.float64)
        wanted = range(members) if keys else [int(pdf["member"].iloc[0])]
        made = [one(x, y, member) for member in wanted]
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(made) for k in keys} | {"member": list(wanted), "w": [w for w, _ in made], "b": [b for _, b in made]})

    def one(x: np.ndarray, y: np.ndarray, member: int) -> tuple[np.ndarray, float]:
        if len(np.unique(y)) < 2:
            rate = min(max(y.mean(), 0.01), 0.99)
            return np.zeros(x.shape[1]), np.log(rate / (1 - rate))
        rng = np.random.default_rng(seed + member)
        rows = np.concatenate([rng.choice(np.flatnonzero(y == c), int((y == c).sum())) for c in (0, 1)])
        x, y = x[rows], y[rows]
        weight = penalty * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        x1 = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.diag([1.0] * x.shape[1] + [0.0])
        w = np.zeros(x1.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge + 1e-9 * np.eye(len(w)), x1.T @ (weight * (p - y)) + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return w[:-1], w[-1]

    kinds = dict(labeled.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "member int, w array<double>, b double"])
    return spread.groupBy(*(keys or ["member"])).applyInPandas(fit, schema)


def score_linear(pool: DataFrame, coefficients: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the mean (mu) and population variance (u_epi) of the members' probabilities; rows aren't shuffled.

    A key's members are one row of a small table, whose size is checked before it is broadcast.
    """
    members = coefficients.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("member", "w", "b"))).alias("__members"))
    members = small(members, "coefficients")
    each = pool.join(members, list(keys)) if keys else pool.crossJoin(members)
    each = each.withColumn("__p", F.transform("__members", lambda m: sigmoid(dot(F.col("x"), m["w"]) + m["b"])))
    each = each.withColumn("mu", _mean("__p"))
    spread = F.aggregate("__p", F.lit(0.0), lambda s, p: s + (p - F.col("mu")) * (p - F.col("mu"))) / F.size("__p")
    return each.withColumn("u_epi", spread).drop("__members", "__p")


def score_neighbours(pool: DataFrame, labeled: DataFrame, k: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Adds mu and u_epi from distances to labelled rows: similarity to positives less that to negatives."""
    from budgetsieve.operators.ranking import joined, zscored

    margins = knn_margin(pool, labeled, k, keys)
    near = margins.select(*keys, "item_id", (-F.col("to_positive")).alias("__pos"), (-F.col("to_negative")).alias("__neg"))
    raw = zscored(near, ["__pos", "__neg"], keys).withColumn("__raw", F.col("z___pos") - F.col("z___neg"))
    scores = raw.select(*keys, "item_id", sigmoid(F.col("__raw")).alias("mu"), (F.lit(1.0) / (F.abs("__raw") + F.lit(1e-3))).alias("u_epi"))
    return joined(pool, scores, [*keys, "item_id"], "inner")


def blended(pool: DataFrame, labeled: DataFrame, blend: float, keys: Sequence[str] = (), kept: Sequence[str] | None = None) -> DataFrame:
    """mu blended with retrieval: the z-score of mu plus blend times that of nearness to a positive, less half that to a negative.

    Keys that lack positives or negatives keep their mu. kept: the columns wanted beside keys, item_id and mu; distances
    are then written with these alone, and not computed again.
    """
    from budgetsieve.operators.ranking import zscored

    near = with_nearest(with_nearest(pool, labeled.where("label = 1"), 1, keys, "__p"), labeled.where("label = 0"), 1, keys, "__n")
    # of a key all rows have a distance to a label or none has
    near = near.withColumns({"__pos": -F.get("__p", F.lit(0)), "__neg": -F.get("__n", F.lit(0))}).drop("__p", "__n")
    if kept is not None:
        near = written(near.select(*keys, "item_id", *kept, "mu", "__pos", "__neg"), "near")
    both = zscored(near, ["mu", "__pos", "__neg"], keys)
    score = F.col("z_mu") + F.lit(float(blend)) * (F.col("z___pos") - F.lit(0.5) * F.col("z___neg"))
    return both.withColumn("mu", F.coalesce(sigmoid(score), "mu")).drop("z_mu", "z___pos", "z___neg", "__pos", "__neg")


def forest_scores(pool: DataFrame, labeled: DataFrame, trees: int = 80, seed: int = 0, depth: int = 12) -> DataFrame:
    """Adds the mean (mu) and variance (u_epi) of the votes of a random forest's trees; classes weigh the same."""
    return score_trees(pool, forest(labeled, trees, seed, depth))


def extra_tree_scores(pool: DataFrame, labeled: DataFrame, trees: int = 80, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the mean (mu) and variance (u_epi) of the votes of extremely randomised trees, for all keys at once."""
    return score_trees(pool, extra_trees(labeled, trees, seed, keys), keys)


def kmeans(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Centroids (part_id, centroid) of full-batch k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=20).fit(pool.select(array_to_vector("x").alias("features")))
    return pool.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "part_id int, centroid array<double>")


def partition_count(n: int, limit: int = 256, scale: bool = False) -> int:
    """How many partitions a pool of n items gets."""
    return min(2048, max(256, -(-n // 1000))) if scale else min(limit, max(2, n // 25))
