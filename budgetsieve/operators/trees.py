"""Trees as tables: extremely randomised trees grown level by level, forests, and scores with a variance over trees.

A tree is rows (tree, node, feature, cut, left, right, p): a row goes left where x[feature] <= cut, and p is
the weighted share of positives; leaves have no feature. What is drawn is a hash of (seed, tree, node,
feature), so that a tree doesn't depend on how it is grown: nodes of many rows take a pass of aggregations a
level, smaller ones are finished in a task, a bundle of trees together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.operators.ranking import joined
from budgetsieve.sources.sinks import in_passes, shared_dir, written
from budgetsieve.sources.workers import ship

#: Labelled rows of a node that are split in one task; trees that a task grows together.
IN_TASK, BUNDLE = 20_000, 8
#: Bytes of trees that are sent to all tasks at a time, and of a node; more targets, or trees, take further passes.
MODEL_BYTES, NODE_BYTES = 64 << 20, 28
#: Depth down to which a node's children are 2 * node and 2 * node + 1; below it they are numbered by digests.
DEEPEST = 58
TREE = ["tree", "node"]
SCHEMA = "tree int, node long, feature int, cut double, left long, right long, p double"


def _mix(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of one 8-byte integer, as Spark's xxhash64 chains it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = seed + p5 + np.uint64(8)
        h = turn(h ^ turn(value * p2, 31) * p1, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)


def _draws(seed: int, tree: int, node: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of features at a node, and a number from 0 to 1 for each feature."""
    h = np.full(1, 42, np.uint64)
    for x in (seed, tree, node):
        h = _mix(np.array([x], np.int64).view(np.uint64), h)
    place = _mix(np.arange(dims, dtype=np.uint64), h)
    unit = (_mix(np.ones(dims, np.uint64), place) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.lexsort((np.arange(dims), place.view(np.int64))), unit


def _children(node: int) -> tuple[int, int]:
    """The numbers of a node's children; those of deep nodes are digests from 1 << 62 on, of which 2 ** 62 differ."""
    if node < 1 << DEEPEST:
        return 2 * node, 2 * node + 1
    h = _mix(np.array([node], np.uint64), np.full(1, 42, np.uint64))
    left, right = (int(_mix(np.array([side], np.uint64), h)[0] >> np.uint64(2)) + (1 << 62) for side in (0, 1))
    return left, right


def _child(side: Column) -> Column:
    """The number of a node's child, 0 on the left and 1 on the right, as _children has it."""
    node, side = F.col("node"), side.cast("long")
    deep = F.shiftrightunsigned(F.xxhash64(node, side), 2) + F.lit(1 << 62)
    return F.when(node < 1 << DEEPEST, F.shiftleft(node, 1) + side).otherwise(deep)


def _purity(w1, w0):
    return (w1 * w1 + w0 * w0) / (w1 + w0)


def grow_in_task(x: np.ndarray, y: np.ndarray, weights: tuple[float, float], tree: int, node: int, seed: int) -> Iterator[tuple]:
    """Rows of the subtree under a node of an extremely randomised tree."""
    c0, c1 = weights
    wanted = max(1, math.isqrt(x.shape[1]))
    todo = [(node, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        own, n, n1 = x[rows], len(rows), int(y[rows].sum())
        p = c1 * n1 / (c1 * n1 + c0 * (n - n1))
        best = None
        if 0 < n1 < n:
            low, high = own.min(0), own.max(0)
            order, unit = _draws(seed, tree, node, x.shape[1])
            features = order[(high > low)[order]][:wanted]
            if len(features):
                cuts = low[features] + unit[features] * (high[features] - low[features])
                left = own[:, features] <= cuts
                l1, ln = left[y[rows] == 1].sum(0), left.sum(0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = _purity(c1 * l1, c0 * (ln - l1)) + _purity(c1 * (n1 - l1), c0 * (n - ln - n1 + l1))
                score[(ln == 0) | (ln == n)] = -1.0
                if score.max() >= 0:
                    best = int(score.argmax())
        if best is None:
            yield tree, node, None, None, None, None, p
            continue
        at = _children(node)
        yield tree, node, int(features[best]), float(cuts[best]), *at, p
        todo += [(at[0], rows[left[:, best]]), (at[1], rows[~left[:, best]])]


def _balanced(labeled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the weights c0 and c1 under which both classes weigh the same; 1 where a key has one class only."""
    sizes = labeled.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("label").alias("__n1"))
    weight = lambda n: F.when(n > 0, F.col("__n") / (F.lit(2.0) * n)).otherwise(F.lit(1.0))
    weights = sizes.select(*keys, "__n", weight(F.col("__n") - F.col("__n1")).alias("c0"), weight(F.col("__n1")).alias("c1"))
    return joined(labeled, weights, keys, "inner")


def _finish(rows: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """Grows what is left of each (tree, node) in the rows of a group; ``trees`` lists the trees that a row is in."""
    kinds = dict(rows.dtypes)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", kind="stable")
        x, y = np.array(pdf["x"].tolist(), np.float64), pdf["label"].to_numpy(np.int64)
        out = [r for t in sorted(pdf["trees"].iloc[0]) for r in grow_in_task(x, y, (pdf["c0"].iloc[0], pdf["c1"].iloc[0]), int(t), int(pdf["node"].iloc[0]), seed)]
        made = dict(zip(["tree", "node", "feature", "cut", "left", "right", "p"], zip(*out)))
        exact = {"feature": "Int32", "left": "Int64", "right": "Int64"}  # a double doesn't hold the numbers of deep nodes
        made = pd.DataFrame({c: pd.array(v, exact[c]) if c in exact else v for c, v in made.items()})
        for k in reversed(keys):
            made.insert(0, k, pdf[k].iloc[0])
        return made

    return rows.groupBy(*keys, *by).applyInPandas(finish, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), SCHEMA]))


def _level(rows: DataFrame, keys: Sequence[str], dims: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One pass over nodes of many rows (keys, tree, node): their rows of the tree, and their rows one level down."""
    at = [*keys, *TREE]
    x = lambda i: F.get("x", F.lit(i))
    ranges = F.array(*[F.struct(F.lit(i).alias("feature"), F.min(x(i)).alias("low"), F.max(x(i)).alias("high")) for i in range(dims)])
    nodes = rows.groupBy(*at).agg(ranges.alias("ranges"), F.count("*").alias("n"), F.sum("label").alias("n1"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))
    longs = lambda *c: [F.col(v).cast("long") if isinstance(v, str) else v for v in c]
    place = F.xxhash64(F.lit(seed).cast("long"), *longs("tree", "node"), F.col("r.feature").cast("long"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *longs("tree", "node"), F.col("r.feature").cast("long"), F.lit(1).cast("long")), 11) / F.lit(float(1 << 53))
    drawn = nodes.select(*at, "n", "n1", "c0", "c1", F.explode("ranges").alias("r")).where("r.high > r.low")
    nth = F.row_number().over(Window.partitionBy(*at).orderBy(place, "r.feature"))  # as many rows as features
    drawn = drawn.select(*at, "n", "n1", "c0", "c1", nth.alias("nth"), "r.feature", (F.col("r.low") + unit * (F.col("r.high") - F.col("r.low"))).alias("cut")).where(F.col("nth") <= max(1, math.isqrt(dims)))
    drawn = written(drawn, "cuts")
    lists = drawn.groupBy(*at).agg(F.collect_list(F.struct("nth", "feature", "cut")).alias("cuts"))
    each = joined(rows.select(*at, "label", "x"), lists, at, "inner").select(*at, "label", "x", F.explode("cuts").alias("c"))
    went = each.where(F.get("x", F.col("c.feature")) <= F.col("c.cut")).groupBy(*at, F.col("c.nth").alias("nth")).agg(F.count("*").alias("ln"), F.sum("label").alias("l1"))
    counted = joined(drawn, went, [*at, "nth"], "inner").where("ln < n")
    n, n1, ln, l1, c0, c1 = (F.col(c) for c in ("n", "n1", "ln", "l1", "c0", "c1"))
    counted = counted.withColumn("score", _purity(c1 * l1, c0 * (ln - l1)) + _purity(c1 * (n1 - l1), c0 * (n - ln - n1 + l1)))
    best = counted.groupBy(*at).agg(F.max_by(F.struct("feature", "cut"), F.struct("score", -F.col("nth"))).alias("b"))
    best = written(best.select(*at, "b.feature", "b.cut"), "splits")
    p = c1 * n1 / (c1 * n1 + c0 * (n - n1))
    split = F.col("feature").isNotNull()
    told = joined(nodes.select(*at, p.alias("p")), best, at).select(*at, "feature", "cut", F.when(split, _child(F.lit(0))).alias("left"), F.when(split, _child(F.lit(1))).alias("right"), "p")
    down = joined(rows, best, at, "inner")
    down = down.withColumn("node", _child(F.get("x", F.col("feature")) > F.col("cut"))).drop("feature", "cut")
    return told, down


def extra_trees(labeled: DataFrame, trees: int = 80, seed: int = 0, keys: Sequence[str] = (), in_task: int = IN_TASK) -> DataFrame:
    """Extremely randomised trees (keys, tree, node ...) of labelled rows (keys, item_id, label 0 or 1, x).

    At a node the square root of the number of features is drawn among those that vary, each with one cut
    between its least and largest value; the purest split is taken, down to pure nodes; classes weigh the
    same. All keys are grown at once.
    """
    ship(labeled.sparkSession)
    rows = _balanced(labeled.select(*keys, "item_id", F.col("label").cast("int").alias("label"), "x"), keys)
    head = rows.agg(F.max("__n").alias("most"), F.max(F.size("x")).alias("dims")).first()
    most, dims = head["most"] or 0, head["dims"] or 0
    rows = rows.drop("__n")
    if most <= in_task:
        bundles = F.array(*[F.array(*[F.lit(t) for t in range(b, min(trees, b + BUNDLE))]) for b in range(0, trees, BUNDLE)])
        return _finish(rows.withColumn("node", F.lit(1).cast("long")).withColumn("trees", F.explode(bundles)), ["trees"], keys, seed)
    at = [*keys, *TREE]
    waiting = rows.withColumn("node", F.lit(1).cast("long")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    told, ready = [], []
    while True:
        waiting = written(waiting, "nodes")
        sizes = waiting.groupBy(*at).agg(F.count("*").alias("__n"), F.sum("label").alias("__n1"))
        large = written(sizes.where((F.col("__n") > in_task) & (F.col("__n1") > 0) & (F.col("__n1") < F.col("__n"))).select(*at, F.lit(True).alias("__large")), "large")
        marked = joined(waiting, large, at)
        ready.append(marked.where("__large IS NULL").drop("__large"))
        if large.isEmpty():
            break
        done, waiting = _level(marked.where("__large").drop("__large"), keys, dims, seed)
        told.append(written(done, "split-nodes"))
    rest = reduce(DataFrame.unionByName, ready).withColumn("trees", F.array("tree"))
    return reduce(DataFrame.unionByName, told, _finish(rest, TREE, keys, seed))


def forest(labeled: DataFrame, trees: int = 80, seed: int = 0, depth: int = 12) -> DataFrame:
    """A random forest of Spark's as a table of trees; classes weigh the same."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = _balanced(labeled, ())
    data = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"), F.when(F.col("label") == 1, F.col("c1")).otherwise(F.col("c0")).alias("weight"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(data)
    path = f"{shared_dir(labeled.sparkSession)}/forest-{labeled.sparkSession.sparkContext.applicationId}-{model.uid}"
    model.write().save(path)
    n = F.col("nodeData")
    split = n["leftChild"] >= 0
    stats = n["impurityStats"]
    p = F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    leaf = lambda c: F.when(split, c)
    saved = labeled.sparkSession.read.parquet(f"{path}/data")
    return saved.select(
        F.col("treeID").alias("tree"), n["id"].cast("long").alias("node"), leaf(n["split"]["featureIndex"]).alias("feature"), leaf(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        leaf(n["leftChild"]).cast("long").alias("left"), leaf(n["rightChild"]).cast("long").alias("right"), p.alias("p"),
    )


class Packed:
    """Trees of one key in arrays: all nodes in a row, and where each tree starts."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
        column = lambda c, none, kind: table[c].fill_null(none).to_numpy().astype(kind, copy=False)
        tree, node = column("tree", -1, np.int64), column("node", -1, np.int64)
        if ((tree[1:] == tree[:-1]) & (node[1:] == node[:-1])).any():
            raise ValueError("two nodes of a tree have one number")
        self.feature = column("feature", -1, np.int32)
        self.cut, self.p = column("cut", 0.0, np.float64), column("p", 0.0, np.float64)
        self.root = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]).astype(np.int32)
        self.left, self.right = (np.full(len(node), -1, np.int32) for _ in range(2))
        for side, child in ((self.left, column("left", -1, np.int64)), (self.right, column("right", -1, np.int64))):
            for first, end in zip(self.root, [*self.root[1:], len(node)]):
                inner = first + np.flatnonzero(self.feature[first:end] >= 0)
                side[inner] = first + np.searchsorted(node[first:end], child[inner])

    def votes(self, x: np.ndarray) -> np.ndarray:
        """p of each row (down) in each tree (across)."""
        at = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            left = x[row, np.maximum(self.feature[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)
        return self.p[at]


def score_trees(pool: DataFrame, trees: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the mean (mu) and population variance (u_epi) of the trees' votes.

    Trees have at most two nodes a labelled row. They are sent to all tasks where those of a key or more fit
    in ``MODEL_BYTES``; other keys take passes of their own, and no row is shuffled. The trees of a key that
    doesn't fit are sent in several passes, of which counts and sums of votes are added up by row. Rows of a key
    without trees are left out.
    """
    spark = pool.sparkSession
    ship(spark)
    trees = written(trees, "trees")
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    sizes = trees.groupBy(key.alias("key"), "tree").agg((F.count("*") * NODE_BYTES).alias("bytes")).orderBy("key", "tree").collect()  # one row a tree
    whole: dict[str, int] = {}
    for r in sizes:
        whole[r["key"]] = whole.get(r["key"], 0) + r["bytes"]
    groups, pieces = in_passes([(k, n) for k, n in whole.items() if n <= MODEL_BYTES], MODEL_BYTES), {}
    for k in (k for k, n in whole.items() if n > MODEL_BYTES):
        pieces[k] = in_passes([(r["tree"], r["bytes"]) for r in sizes if r["key"] == k], MODEL_BYTES)

    def sent(rows: DataFrame):
        held = rows.withColumn("__key", key).drop(*keys).toArrow()
        return _voting(spark.sparkContext.broadcast({k: Packed(held.filter(pc.equal(held["__key"], k))) for k in held["__key"].unique().to_pylist()}))

    parts = []
    for wanted in groups:
        scored = pool.where(key.isin(wanted)).withColumn("__v", sent(trees.where(key.isin(wanted)))(key, "x"))
        parts.append(scored.withColumns({"mu": F.col("__v.mean"), "u_epi": F.col("__v.spread")}).drop("__v"))
    for k, bundles in pieces.items():
        own, on = pool.where(key == k), [*keys, "item_id"]
        votes = [own.select(*on, F.lit(i).alias("nth"), sent(trees.where((key == k) & F.col("tree").isin(bundle)))(key, "x").alias("v")).select(*on, F.struct("nth", "v.*").alias("v")) for i, bundle in enumerate(bundles)]
        each = reduce(DataFrame.unionByName, votes).groupBy(*on).agg(F.array_sort(F.collect_list("v")).alias("v"))  # in order, so that sums are the same each time
        total = lambda f: F.aggregate("v", F.lit(0.0), lambda sum_, v: sum_ + v["n"] * f(v))
        n, mu = total(lambda v: F.lit(1.0)), total(lambda v: v["mean"])
        sums = each.withColumn("mu", mu / n)
        spread = total(lambda v: v["spread"] + (v["mean"] - F.col("mu")) * (v["mean"] - F.col("mu"))) / n
        sums = sums.withColumn("u_epi", spread)
        parts.append(joined(own, sums.select(*on, "mu", "u_epi"), on, "inner"))
    if not parts:
        return pool.where("false").withColumns({"mu": F.lit(0.0), "u_epi": F.lit(0.0)})
    return reduce(DataFrame.unionByName, parts)


def _voting(sent):
    """Number, mean and variance of the votes of the trees of a row's key."""

    @F.pandas_udf("n long, mean double, spread double")
    def score(key: pd.Series, x: pd.Series) -> pd.DataFrame:
        n, mean, spread = np.zeros(len(x), np.int64), np.full(len(x), np.nan), np.full(len(x), np.nan)
        for k, rows in key.groupby(key).indices.items():
            votes = np.concatenate([sent.value[k].votes(np.array(x.iloc[rows[i : i + 1024]].tolist(), np.float64)) for i in range(0, len(rows), 1024)])
            n[rows], mean[rows], spread[rows] = votes.shape[1], votes.mean(1), votes.var(1)
        return pd.DataFrame({"n": n, "mean": mean, "spread": spread})

    return score
