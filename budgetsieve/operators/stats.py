"""Paired and unpaired tests over result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetsieve.operators.ranking import running

#: Deltas up to which a key's sign patterns are all listed.
MOST_EXACT = 20
#: Draws whose partial sums go in one row.
CHUNK = 1000


def finite(deltas: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a finite number."""
    return deltas.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def permutation_exact(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Two-sided sign-flip test on the mean over all 2^n sign patterns, in SQL functions.

    Keys of more than MOST_EXACT deltas are tested by drawn signs (see :func:`permutation_sampled`).
    """
    rows = finite(deltas, value)
    rows = rows.drop(*[c for c in ("n", "d", "p") if c not in keys and c != value])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    few = rows.join(sizes.where(F.col("n") <= MOST_EXACT), list(keys))
    lists = few.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(value)).alias("d"))
    flips = lists.withColumn("pattern", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), "n") - 1).cast("int"))))
    mean = F.aggregate(F.transform("d", lambda x, i: x * (F.lit(1) - F.lit(2) * (F.floor(F.col("pattern") / F.pow(F.lit(2.0), i)) % 2))), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    exact = flips.groupBy(*keys).agg(F.avg((F.abs(mean) >= observed - F.lit(1e-12)).cast("double")).alias("p"), F.first("n").alias("n"))
    many = sizes.where(F.col("n") > MOST_EXACT)
    drawn = permutation_sampled(rows.join(many.drop("n"), list(keys), "left_semi"), keys, value).join(many, list(keys))
    return exact.unionByName(drawn.select(*keys, "p", "n"))


def drawn_sums(rows: DataFrame, keys: Sequence[str], value: str, draws: int, weigh) -> DataFrame:
    """(keys, draw, total, weight): sums over a key's rows of value times each draw's weight of the row.

    A row's weights come from a generator seeded by its content (rows should differ in some column), so
    that any task may draw them. Tasks send partial sums, whatever the size of a key.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "chunk int, total array<double>, weight array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, seed, x in zip(batch[list(keys)].itertuples(index=False, name=None), batch["__seed"].tolist(), batch[value].tolist()):
                w = weigh(np.random.default_rng(seed), draws)
                if key not in held:
                    held[key] = np.zeros((2, draws))
                held[key] += (w * x, w)
                if len(held) * draws >= 2_000_000:  # bounded memory, many keys
                    yield give(held)
                    held = {}
        if held:
            yield give(held)

    def give(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        out = [(*key, c, sums[0, c * CHUNK : (c + 1) * CHUNK], sums[1, c * CHUNK : (c + 1) * CHUNK]) for key, sums in held.items() for c in range(-(-draws // CHUNK))]
        return pd.DataFrame(out, columns=[*keys, "chunk", "total", "weight"])

    seeded = rows.select(*keys, F.col(value).cast("double").alias(value), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(1 << 62)).alias("__seed"))
    parts = seeded.mapInPandas(run, schema)
    each = parts.select(*keys, "chunk", F.posexplode(F.arrays_zip("total", "weight")).alias("i", "s")).select(*keys, (F.col("chunk") * CHUNK + F.col("i")).alias("draw"), "s.*")
    return each.groupBy(*keys, "draw").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def permutation_sampled(deltas: DataFrame, keys: Sequence[str], value: str = "delta", draws: int = 100_000, seed: int = 0) -> DataFrame:
    """The same test by seeded draws of signs, for larger n: the share of draws that are as far from 0."""
    rows = finite(deltas, value).withColumn("__draws", F.lit(seed))
    sums = drawn_sums(rows, keys, value, draws, lambda rng, n: np.unpackbits(np.frombuffer(rng.bytes(-(-n // 8)), np.uint8))[:n] * 2.0 - 1.0)
    observed = rows.groupBy(*keys).agg(F.sum(value).alias("observed"), F.count("*").alias("n"))
    far = F.abs(F.col("total") / F.col("n")) >= F.abs(F.col("observed") / F.col("n")) - F.lit(1e-12)
    return sums.join(F.broadcast(observed), list(keys)).groupBy(*keys).agg(F.avg(far.cast("double")).alias("p"))


def value_ranks(rows: DataFrame, keys: Sequence[str], value: Column, **counts: Column) -> DataFrame:
    """(keys, v, n, counts, r): each distinct value with its rows and their average rank from 1.

    Rows are counted by value, and counts are summed along ranges of values: no key is gathered.
    """
    by_value = rows.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return running(by_value, "v", "n", keys).withColumn("r", F.col("before") + (F.col("n") + 1) / F.lit(2.0)).drop("before")


def wilcoxon(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Signed-rank sums over finite deltas that aren't zero with the normal approximation (ties corrected)."""
    rows = finite(deltas, value).where(F.abs(value) > 1e-12)
    ranked = value_ranks(rows, keys, F.abs(value), up=F.col(value) > 0, down=F.col(value) < 0)
    t = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum(F.col("down") * F.col("r")).alias("w_minus"), F.sum("n").alias("n"), F.sum(t * (t * t - 1)).alias("ties"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return sums.withColumn("z", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance))).drop("ties")


def normal_p(z: Column, two_sided: bool = True) -> Column:
    """p-value of a normal deviate: two-sided, or that of so low a one.

    The error function's series of positive terms, 200 of them, which is exact to rounding up to |z| = 10.
    """
    x = F.least(F.abs(z), F.lit(10.0)) / F.lit(2**0.5)
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda s, n: F.struct((s["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n + 1)).alias("term"), (s["sum"] + s["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n + 1)).alias("sum"))
    erf = F.lit(2 / np.pi**0.5) * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step)["sum"]
    return F.greatest(F.lit(0.0), F.lit(1.0) - erf) if two_sided else (F.lit(1.0) + F.signum(z) * erf) / F.lit(2.0)


def sign_p(wins: int, n: int) -> float:
    """Two-sided exact binomial p at one half."""
    if n == 0:
        return 1.0
    low = min(wins, n - wins)
    return min(1.0, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n)


def sign_test(deltas: DataFrame, keys: Sequence[str], value: str = "delta", ties: str = "drop") -> DataFrame:
    """Counts and exact binomial p; ties are dropped or count as improved."""
    d = F.col(value)
    counts = deltas.groupBy(*keys).agg(F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"))
    wins = F.col("wins") + (F.col("ties") if ties == "improved" else F.lit(0))
    n = (wins + F.col("losses")).cast("int")
    # log of n choose i by sums of logarithms
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(j <= i, F.log((n - i + j).cast("double")) - F.log(j.cast("double"))).otherwise(0.0))
    low = F.least(wins, F.col("losses")).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    return counts.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail)))


def mann_whitney(rows: DataFrame, keys: Sequence[str], value: str, group: str, first, second) -> DataFrame:
    """U of the first group against the second, P(first lower) and z with continuity (alternative: lower)."""
    ranked = value_ranks(finite(rows, value).where(F.col(group).isin(first, second)), keys, F.col(value), one=F.col(group) == first, two=F.col(group) == second)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("one") * F.col("r")).alias("r1"), F.sum("one").alias("n"), F.sum("two").alias("m")).where("n > 0 and m > 0")
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    u = F.col("r1") - n * (n + 1) / 2
    return sums.withColumn("u", u).withColumn("p_lower", F.lit(1.0) - F.col("u") / (n * m)).withColumn("z", (F.col("u") - n * m / 2 + 0.5) / F.sqrt(n * m * (n + m + 1) / 12)).drop("r1")


def bootstrap_ci(deltas: DataFrame, keys: Sequence[str], value: str = "delta", draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean with a 95 % interval of resampled means; a row's weight in each draw is Poisson(1), drawn where the row is."""
    rows = finite(deltas, value).withColumn("__draws", F.lit(seed))
    sums = drawn_sums(rows, keys, value, draws, lambda rng, n: rng.poisson(1.0, n).astype(np.float64))
    means = sums.where(F.col("weight") > 0).withColumn("__m", F.col("total") / F.col("weight"))
    spread = means.groupBy(*keys).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean")).join(spread, list(keys))
