"""Exact nearest neighbours: a small reference goes to all tasks, a large one into inverted lists.

An inverted list holds the reference vectors nearest to a pivot and the radius that they span. Lists go to
all tasks, as many at a time as fit; rows stay where they are, and only distances found in several such passes
are shuffled. A row skips the lists that can't hold anything nearer than what it has: its distance to the pivot
less the radius is the least that a list could hold, and pivots, which are reference vectors, bound its nearest
from the start. Lists of near pivots make a block, and rows meet a block in groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.operators.ranking import joined
from budgetsieve.sources.sinks import in_passes, written
from budgetsieve.sources.workers import ship

#: Bytes of reference vectors that are sent to every task; larger references are searched in lists.
SENT_BYTES = 16 << 20
#: Bytes of lists that are sent to every task at a time.
PASS_BYTES = 48 << 20
#: Reference vectors from which a block of lists is full, and rows of one group that meets it.
BLOCK_ROWS, GROUP_ROWS = 4096, 1024
#: Vectors of a block up to which a row's are compared one by one, as far as its bound lets them in.
FEW = 32
#: Pivots of a key at most; their number is the square root of the key's vectors.
PIVOTS = 4096


def k_nearest(x: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of each row's k nearest of b, in order; differences of the nearest are summed, not expanded."""
    near, at = [], []
    more = min(len(b), k + 8)
    squares = (b * b).sum(1)
    for i in range(0, len(x), 256):
        rows = x[i : i + 256]
        rough = squares[None, :] - 2 * rows @ b.T
        place = np.sort(np.argpartition(rough, more - 1, axis=1)[:, :more], axis=1)
        d = np.sqrt(((rows[:, None, :] - b[place]) ** 2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near.append(np.take_along_axis(d, order, 1))
        at.append(np.take_along_axis(place, order, 1))
    empty = np.zeros((0, min(k, len(b))))
    return (np.vstack(near), np.vstack(at)) if near else (empty, empty.astype(np.int64))


def matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.float64)


def key_of(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def gathered(reference: DataFrame, keys: Sequence[str], order: str) -> dict[str, np.ndarray]:
    """Vectors of each key in an order, for a table whose size was checked."""
    held = reference.select(key_of(keys).alias("key"), order, "x").toPandas().sort_values(order, kind="stable")
    return {k: matrix(g["x"]) for k, g in held.groupby("key")}


def _sent(pool: DataFrame, reference: DataFrame, k: int, keys: Sequence[str], name: str) -> DataFrame:
    sent = pool.sparkSession.sparkContext.broadcast(gathered(reference, keys, "item_id"))

    @F.pandas_udf("array<double>")
    def near(key: pd.Series, x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        for value, rows in key.groupby(key).indices.items():
            if value in sent.value:
                found = k_nearest(matrix(x.iloc[rows]), sent.value[value], k)[0]
                for i, d in zip(rows, found):
                    out[i] = d
        return pd.Series(out, dtype=object)

    return pool.withColumn(name, near(key_of(keys), "x"))


def _merged(best: np.ndarray, row: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Each row's least distances, as many as it had, from these and further ones (row, d)."""
    m, k = best.shape
    rows, all_ = np.concatenate([np.repeat(np.arange(m), k), row]), np.concatenate([best.ravel(), d])
    order = np.lexsort((all_, rows))
    rows = rows[order]
    first = np.searchsorted(rows, np.arange(m))
    return all_[order][np.arange(len(rows)) - first[rows] < k].reshape(m, k)


class Held:
    """Lists of one key in a task: vectors by list, pivots and radii."""

    def __init__(self, x: np.ndarray, at: np.ndarray, first: int, pivots: np.ndarray, radii: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.x, self.squares, self.pivots, self.radii = x[order], (x[order] ** 2).sum(1), pivots, radii
        starts = np.searchsorted(at[order] - first, np.arange(len(pivots) + 1))
        self.blocks, low = [], 0
        for i in range(len(pivots)):
            if starts[i + 1] - starts[low] >= BLOCK_ROWS or i == len(pivots) - 1:
                self.blocks.append((low, i + 1, starts[low], starts[i + 1]))
                low = i + 1

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Distances of the k nearest of each row, in order; infinite where there are fewer or none within its bound."""
        best, qq = np.full((len(q), k), np.inf), (q * q).sum(1)
        rough = qq[:, None] + (self.pivots**2).sum(1) - 2 * q @ self.pivots.T
        slack = 1e-12 * (qq + self.squares.max(initial=0.0))  # more than what expanded squares lose
        bound = np.sqrt(np.partition(rough, k - 1, axis=1)[:, k - 1].clip(0) + slack) if len(self.pivots) >= k else np.full(len(q), np.inf)
        least = np.where(self.radii < 0, np.inf, np.sqrt((rough - slack[:, None]).clip(0)) - self.radii)
        for low, high, start, end in self.blocks:
            rows = np.flatnonzero(least[:, low:high].min(axis=1) <= bound * (1 + 1e-9))
            if end == start:
                continue
            b, squares = self.x[start:end], self.squares[start:end]
            for i in range(0, len(rows), 256):
                own = rows[i : i + 256]
                inside = qq[own, None] + squares - 2 * q[own] @ b.T <= (bound[own] ** 2 * (1 + 1e-9) + slack[own])[:, None]
                n = inside.sum(axis=1)
                many = n > max(FEW, k + 8)
                if many.any():  # bounds are loose, or many vectors are alike
                    found = k_nearest(q[own[many]], b, k)[0]
                    row, d = np.repeat(np.flatnonzero(many), found.shape[1]), found.ravel()
                    best[own] = _merged(best[own], row, d)
                row, at = np.nonzero(inside & ~many[:, None])
                best[own] = _merged(best[own], row, np.sqrt(((q[own[row]] - b[at]) ** 2).sum(axis=1)))
                bound[own] = np.minimum(bound[own], best[own, k - 1])
        return best


class Lists:
    """A reference (keys, item_id, x) in inverted lists: rows with their list, and pivots and radii by key."""

    def __init__(self, reference: DataFrame, keys: Sequence[str] = ()):
        spark = reference.sparkSession
        ship(spark)
        self.keys = list(keys)
        unit = F.pmod(F.xxhash64("item_id", F.lit("pivot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sizes = reference.groupBy(*keys).agg(F.try_divide(F.least(F.sqrt(F.count("*")), F.lit(float(PIVOTS))), F.count("*")).alias("__rate"), F.min(unit).alias("__least"))
        drawn = joined(reference.withColumn("__unit", unit), sizes, keys, "inner").where("__unit < __rate OR __unit = __least")
        self.pivots = {k: self._ordered(p) for k, p in gathered(drawn, keys, "item_id").items()}
        sent = spark.sparkContext.broadcast(self.pivots)

        @F.pandas_udf("list int, far double")
        def place(key: pd.Series, x: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"list": np.zeros(len(x), np.int32), "far": np.zeros(len(x))})
            for value, rows in key.groupby(key).indices.items():
                d, at = k_nearest(matrix(x.iloc[rows]), sent.value[value], 1)
                out.iloc[rows, 0], out.iloc[rows, 1] = at[:, 0].astype(np.int32), d[:, 0]
            return out

        placed = reference.select(*keys, "item_id", "x", place(key_of(keys), "x").alias("__p"))
        self.rows = written(placed.select(*keys, "item_id", "x", "__p.list", "__p.far"), "lists")
        spans = self.rows.groupBy(key_of(keys).alias("key"), "list").agg(F.max("far").alias("radius"), F.sum(8 * F.size("x").cast("long")).alias("bytes")).orderBy("key", "list").toPandas()  # one row a list
        self.radii = {k: np.full(len(p), -np.inf) for k, p in self.pivots.items()}
        self.bytes: dict[str, list[tuple[int, int]]] = {}
        for key, at, radius, n in zip(spans["key"], spans["list"], spans["radius"], spans["bytes"]):
            self.radii[key][at] = radius
            self.bytes.setdefault(key, []).append((int(at), int(n)))

    @staticmethod
    def _ordered(pivots: np.ndarray) -> np.ndarray:
        """Pivots in an order in which near ones are close to each other."""
        return pivots[np.argsort(k_nearest(pivots, pivots[:: max(1, int(np.sqrt(len(pivots))))], 1)[1][:, 0], kind="stable")]

    def _sent(self, wanted: dict[str, tuple[int, int]]):
        """A function that finds distances among some lists (first, end) of keys."""
        key, ranges = key_of(self.keys), None
        for k, (first, end) in wanted.items():
            own = (key == k) & (F.col("list") >= first) & (F.col("list") < end)
            ranges = own if ranges is None else ranges | own
        table = self.rows.where(ranges).select(key.alias("key"), "list", "x").toArrow()
        keys, at, dims = table["key"].to_numpy(), table["list"].to_numpy(), len(table["x"][0])
        x = np.ascontiguousarray(table["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims))
        held = {k: Held(x[keys == k], at[keys == k], first, self.pivots[k][first:end], self.radii[k][first:end]) for k, (first, end) in wanted.items()}
        del table, x
        return self.rows.sparkSession.sparkContext.broadcast(held)

    def nearest(self, pool: DataFrame, k: int, name: str = "nearest") -> DataFrame:
        """(keys, item_id, name): the distances of each row's x to its k nearest vectors, in order."""
        return self.added(pool, k, name).where(F.col(name).isNotNull()).select(*self.keys, "item_id", name)

    def added(self, pool: DataFrame, k: int, name: str = "nearest") -> DataFrame:
        """The pool with these distances; null where a row's key has no vectors."""
        key, on = key_of(self.keys), [*self.keys, "item_id"]

        def found(rows: DataFrame, wanted: dict[str, tuple[int, int]]) -> DataFrame:
            return rows.where(key.isin(list(wanted))).withColumn(name, _searching(self._sent(wanted), k)(key, "x"))

        whole = {v: sum(n for _, n in lists) for v, lists in self.bytes.items()}
        parts = [found(pool, {v: (0, len(self.pivots[v])) for v in wanted}) for wanted in in_passes([x for x in whole.items() if x[1] <= PASS_BYTES], PASS_BYTES)]
        split = [v for v, n in whole.items() if n > PASS_BYTES]
        if split:  # of each pass distances alone are shuffled
            slim = pool.select(*on, "x")
            each = [found(slim, {v: (lists[0], lists[-1] + 1)}).select(*on, name).where(F.size(name) > 0) for v in split for lists in in_passes(self.bytes[v], PASS_BYTES)]
            both = reduce(DataFrame.unionByName, each).groupBy(*on).agg(F.flatten(F.collect_list(name)).alias(name))
            parts.append(joined(pool.where(key.isin(split)), both.withColumn(name, F.slice(F.array_sort(name), 1, k)), on))
        rest = pool.where(~key.isin(list(whole))) if whole else pool
        return reduce(DataFrame.unionByName, parts, rest.withColumn(name, F.lit(None).cast("array<double>")))


def _searching(sent, k: int):
    """Distances to the k nearest vectors of a row's key, of which a task has lists."""

    @F.pandas_udf("array<double>")
    def near(key: pd.Series, x: pd.Series) -> pd.Series:
        out: list = [[]] * len(x)
        for value, rows in key.groupby(key).indices.items():
            for i in range(0, len(rows), GROUP_ROWS):
                own = rows[i : i + GROUP_ROWS]
                for at, d in zip(own, sent.value[value].search(matrix(x.iloc[own]), k)):
                    out[at] = d[d < np.inf]
        return pd.Series(out, dtype=object)

    return near


def with_nearest(pool: DataFrame, reference: DataFrame, k: int, keys: Sequence[str] = (), name: str = "nearest", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The pool with the distances of each row's x to its k nearest reference vectors, in order; null for keys without any.

    A reference of up to ``sent_bytes`` goes to all tasks at once; a larger one is searched in inverted lists.
    """
    ship(pool.sparkSession)
    reference = written(reference.select(*keys, "item_id", "x"), "reference")
    size = reference.agg(F.sum(8 * F.size("x").cast("long"))).first()[0] or 0
    if size <= sent_bytes:
        return _sent(pool, reference, k, keys, name)
    return Lists(reference, keys).added(pool, k, name)


def nearest(pool: DataFrame, reference: DataFrame, k: int, keys: Sequence[str] = (), name: str = "nearest", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(keys, item_id, name): the distances of with_nearest. Rows of a key without reference vectors are left out."""
    found = with_nearest(pool.select(*keys, "item_id", "x"), reference, k, keys, name, sent_bytes)
    return found.where(F.col(name).isNotNull()).select(*keys, "item_id", name)


# ---- clusters


class Centres:
    """Centres in groups around some of them, so that most are passed over by the triangle inequality."""

    def __init__(self, centres: np.ndarray):
        self.all = centres
        pivots = centres[:: max(1, int(np.sqrt(len(centres))))]
        home = k_nearest(centres, pivots, 1)
        self.pivots, self.members, self.radius = pivots, [], []
        for g in range(len(pivots)):
            own = np.flatnonzero(home[1][:, 0] == g)
            self.members.append(own)
            self.radius.append(home[0][own, 0].max() if len(own) else -np.inf)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row's nearest centre, and its distance; ties: the first centre."""
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        if not len(x):
            return at, best
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T, 0))
        order = np.argsort(d, axis=1)
        for nth in range(len(self.pivots)):
            group = order[:, nth]
            for g in np.unique(group):
                own = self.members[g]
                rows = np.flatnonzero((group == g) & (d[:, g] - self.radius[g] <= best + 1e-6))
                if not len(rows) or not len(own):
                    continue
                near, place = k_nearest(x[rows], self.all[own], 1)
                near, place = near[:, 0], own[place[:, 0]]
                better = (near < best[rows]) | ((near == best[rows]) & (place < at[rows]))
                best[rows[better]], at[rows[better]] = near[better], place[better]
        return at, best


def assign(pool: DataFrame, centres: DataFrame, name: str = "part_id", distance: str | None = None) -> DataFrame:
    """Adds the part_id of the nearest centre (part_id, centroid), a table of 2,048 rows at most; rows aren't shuffled."""
    spark = pool.sparkSession
    ship(spark)
    held = centres.select("part_id", "centroid").orderBy("part_id").toPandas()
    if len(held) > 2048:
        raise ValueError("at most 2,048 centres are sent to all tasks")
    ids, sent = held["part_id"].to_numpy(), spark.sparkContext.broadcast(matrix(held["centroid"]))
    made: list[Centres] = []

    @F.pandas_udf("part int, far double")
    def place(x: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Centres(sent.value))
        at, far = made[0].assign(matrix(x)) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"part": ids[at].astype(np.int32), "far": far})

    out = pool.withColumn("__place", place("x")).withColumn(name, F.col("__place.part"))
    return (out.withColumn(distance, F.col("__place.far")) if distance else out).drop("__place")


#: Rows of a batch, and batches of a fit: no more rows are read into it. Starts of which the best is taken.
BATCH, BATCHES, STARTS = 4096, 200, 3


def _spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn in proportion to its squared distance from those before."""
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = far.sum()
        chosen.append(int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def minibatch_kmeans(pool: DataFrame, k: int, seed: int = 0, batch: int = BATCH, batches: int = BATCHES, starts: int = STARTS) -> DataFrame:
    """Centres (part_id, centroid) of mini-batch k-means.

    Batches of rows in hash order move each centre towards the mean of all rows it has had, so that its
    steps get smaller; centres with under a hundredth of the rows of the fullest one are put on rows of the
    batch every tenth batch. At most batch * batches rows are drawn by hash, and where there are fewer they
    are read again. Each start streams through the batches in a task of its own; the best by the mean squared
    distance of one more batch is kept.
    """
    spark = pool.sparkSession
    ship(spark)
    n = pool.count()
    place = F.xxhash64("item_id", F.lit(f"{seed}:batch"))
    rate = min(1.0, 1.2 * batch * batches / max(1, n))
    upto = lambda share: F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    drawn = pool.select("item_id", "x", place.alias("__place")).where(F.col("__place") <= upto(rate))
    drawn = written(drawn, "drawn")
    rows = drawn.count()
    passes = max(1, min(batches, 40 * max(1, -(-rows // batch))) * batch // max(1, rows))
    turns = drawn.select("item_id", "x", "__place", F.explode(F.sequence(F.lit(0), F.lit(max(0, passes - 1)))).alias("turn"))
    turns = turns.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    order = F.when(F.col("turn") == 0, F.col("__place")).otherwise(F.xxhash64("__place", "turn"))
    dealt = turns.repartitionByRange(starts, "start").sortWithinPartitions("start", "turn", order, "item_id").select("start", "x")

    def fit(pieces):
        state: dict = {}

        def step(x: np.ndarray, start: int) -> None:
            if "centres" not in state:
                state["rng"] = np.random.default_rng(seed + start)
                state["centres"] = _spread_out(x[: max(k, 3 * batch)], k, state["rng"])
                state["count"], state["batch"] = np.zeros(k), 0
            at, far = Centres(state["centres"]).assign(x)
            sums = np.zeros_like(state["centres"])
            np.add.at(sums, at, x)
            had, now = state["count"], np.bincount(at, minlength=k)
            total = had + now
            moved = now > 0
            state["centres"][moved] = (state["centres"][moved] * had[moved, None] + sums[moved]) / total[moved, None]
            state["count"], state["batch"], state["loss"] = total, state["batch"] + 1, float((far**2).mean())
            if state["batch"] % 10 == 0:
                low = np.flatnonzero(total < 0.01 * total.max())[: len(x) // 2]
                state["centres"][low] = x[state["rng"].choice(len(x), len(low), replace=False)]
                state["count"][low] = total[total >= 0.01 * total.max()].min()

        held, size, now = [], 0, None
        first = max(batch, k)  # the first batch also holds the rows that centres start on

        def give(start):
            return pd.DataFrame({"start": start, "part_id": np.arange(k, dtype=np.int32), "centroid": list(state["centres"])})

        for piece in pieces:
            for start, group in piece.groupby("start", sort=True):
                if now is not None and start != now:
                    if held:
                        step(np.vstack(held), now)
                    yield give(now)
                    state.clear()
                    held, size = [], 0
                now = start
                held.append(matrix(group["x"]))
                size += len(group)
                if size >= (first if "centres" not in state else batch):
                    step(np.vstack(held), now)
                    held, size = [], 0
        if now is not None:
            if held and (size >= batch // 4 or "centres" not in state):
                step(np.vstack(held), now)
            yield give(now)

    found = written(dealt.mapInPandas(fit, "start int, part_id int, centroid array<double>"), "centres")
    test = written(pool.where(F.xxhash64("item_id", F.lit(f"{seed}:test")) <= upto(min(1.0, batch / max(1, n)))).select("item_id", "x"), "test")
    losses = [assign(test, found.where(F.col("start") == s), "part_id", "far").agg(F.avg(F.col("far") * F.col("far"))).first()[0] for s in range(starts)]
    best = min(range(starts), key=lambda s: (losses[s] is None, losses[s], s))
    return found.where(F.col("start") == best).select("part_id", "centroid")


def centres_by_hash(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows in hash order as centres, numbered in that order."""
    order = [F.md5(F.concat(F.lit(f"{seed}:centre:"), F.col("item_id").cast("string"))), F.col("item_id")]
    first = pool.select("item_id", "x").orderBy(*order).limit(k)
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("part_id"), F.col("x").alias("centroid"))
