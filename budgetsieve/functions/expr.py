"""Column expressions that every operator builds on; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: expressions that a lambda reads are otherwise computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def quotient(a: Column | str, b: Column | str) -> Column:
    """a / b of doubles as IEEE 754 has it: infinite or NaN over zero, with the zero's sign, where Spark has an error or null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sequential dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column | str, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(col(a), lambda x: x / n)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def ucb_bonus(step: Column, pulls: Column, scale: float = 1.0) -> Column:
    """Optimism for arms that were pulled seldom: sqrt(2 ln t / max(1, n))."""
    return F.lit(scale) * F.sqrt(F.lit(2.0) * F.log(F.greatest(step, F.lit(2)).cast("double")) / F.greatest(pulls, F.lit(1)).cast("double"))


def hash_order(item: Column | str, seed: int, purpose: str) -> Column:
    """A reproducible random order: the digest of seed, purpose and id. Ties: order by the id next."""
    return F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), col(item).cast("string")))


def rrf_term(rank: Column, weight: float, k: int = 60) -> Column:
    """A list's share in reciprocal-rank fusion; ranks start at 0."""
    return F.lit(float(weight)) / (F.lit(float(k)) + rank.cast("double"))


def half_even(x: Column) -> Column:
    """Rounding of halves to even numbers, as long."""
    return F.bround(x).cast("long")


def safe_name(c: Column | str, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(col(c), r"[^A-Za-z0-9_.-]+", "_"), 1, longest)


def string_offset(c: Column | str) -> Column:
    """The sum of (position from 1) times code over the characters: a seed for a name."""
    return F.aggregate(F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x, i: (i + 1).cast("long") * F.ascii(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def mean_std(c: Column | str) -> Column:
    """'mean +/- sample deviation' to four places, as an aggregate."""
    return F.format_string("%.4f +/- %.4f", F.avg(col(c)), F.coalesce(F.stddev_samp(col(c)), F.lit(0.0)))


def metric_name(c: Column | str) -> Column:
    """A metric's name as a column name."""
    return F.replace(F.replace(F.replace(col(c), F.lit("@"), F.lit("_at_")), F.lit("/"), F.lit("_")), F.lit("."), F.lit("p"))


def stable_seed(c: Column | str, modulus: int = 2147483000) -> Column:
    """A positive seed for a row from its digest."""
    return F.pmod(F.conv(F.substring(F.md5(col(c)), 1, 15), 16, 10).cast("long"), F.lit(modulus)) + 1
