"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels table: 0 for toxic, 1 for low quality, 2 for good. One weight a hashed
word (and a few marks of a text's shape) is shared by all grades, and ordered thresholds cut the
score into grades: P(grade <= j) = sigmoid(threshold_j - w.x). The expected grade and the tail
probability P(grade >= 2) select documents; a document is kept where the tail probability is at
least one half.

The model is fitted on at most ``sample`` labelled documents (hash order of doc_id); counts of
words in that sample choose the words that get a weight, and counts by grade how freely. Each document is scored on its whole
text. Null and empty texts have no words and are scored by the thresholds alone. Labels with nulls
are ignored; repeated labels of one document give its lowest grade, and of rows that repeat a doc_id
the least text is learned from. With no usable labels, or with
one grade only, every document keeps tail probability 1 and is kept. Repeated rows get equal results; empty tables
give empty ones; extra columns are ignored by :func:`rate` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import own_cache, prepare, text_or_empty

PLACES = 1 << 18
SAMPLE, LEAST_DOCUMENTS, PENALTY = 8000, 4, 1.0
LEAST_EVIDENCE, DOUBT = 6.0, 16.0  # places that tell the grades apart by fewer nats have a penalty so many times larger
GRADES = 3

_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_LETTERS = bytes(i for i in range(256) if not (chr(i).isalpha() and i < 128) and i < 128)
_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_NOT_SYMBOL = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum() or chr(i) in " \t\r\n.,;:'\"()-?")


class _Places(dict):
    """Words to hashed places, remembered up to a bound; long words aren't, so that the bound holds in bytes."""

    def __missing__(self, word: bytes) -> int:
        place = zlib.crc32(word) & (PLACES - 1)
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = place
        return place


_places = _Places()


def features(text: str) -> np.ndarray:
    """The distinct hashed places of a text's words, their first four, six and eight bytes (for inflected words), and its shape."""
    raw = text.encode()
    words = raw.translate(_WORDS).split()
    n = max(1, len(raw))
    letters = max(1, len(raw.translate(None, _LETTERS)))
    shape = (
        b"\x01upper%d" % min(9, 10 * len(raw.translate(None, _NOT_UPPER)) // letters),
        b"\x01symbol%d" % min(9, 40 * len(raw.translate(None, _NOT_SYMBOL)) // n),
        b"\x01length%d" % min(12, len(words).bit_length()),
        b"\x01fresh%d" % (10 * len(set(words)) // max(1, len(words))),
    )
    distinct = set(words)
    heads = {b"\x02" + w[:4] for w in distinct if len(w) >= 4} | {b"\x03" + w[:6] for w in distinct if len(w) >= 6} | {b"\x04" + w[:8] for w in distinct if len(w) >= 8}
    return np.unique(np.fromiter(map(_places.__getitem__, {*distinct, *heads, *shape}), np.int32))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than the grades; none where there was nothing to learn from

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def minimise(f, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps; f gives value and gradient."""
    value, slope = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + (a - y @ d / (s @ y)) * s
        t = 1.0 if pairs else min(1.0, 1 / max(1e-9, np.abs(slope).sum()))
        for _ in range(30):
            new, new_slope = f(x + t * d)
            if new <= value + 1e-4 * t * (slope @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, new_slope - slope
        done = value - new < 1e-6 * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if done:
            break
    return x


def evidence(rows: list[np.ndarray], grades: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each place's presence against the best cut of the grades into low and high."""
    best = np.zeros(len(counts))
    n = len(rows)

    def gain(low: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
        q = low / np.maximum(size, 1)
        some, others = np.where(q > 0, q, 1.0), np.where(q < 1, 1 - q, 1.0)
        return size * (q * np.log(some / share) + (1 - q) * np.log(others / (1 - share)))

    for cut in np.unique(grades)[:-1]:
        below = [r for r, g in zip(rows, grades) if g <= cut]
        low = np.bincount(np.concatenate(below), minlength=len(counts))
        share = len(below) / n
        best = np.maximum(best, gain(low, counts, share) + gain(len(below) - low, n - counts, share))
    return best


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY) -> Model:
    """Weights and ordered thresholds by penalised maximum likelihood."""
    there = np.unique(grades)
    if len(there) < 2:
        return Model(np.zeros(PLACES, np.float32), np.zeros(0))
    counts = np.bincount(np.concatenate(rows), minlength=PLACES)
    used = np.flatnonzero((counts >= LEAST_DOCUMENTS) & (counts < len(rows)))
    # one penalty for all would spread the weight of few telling words over thousands that tell little
    held = np.where(evidence(rows, grades, counts)[used] >= LEAST_EVIDENCE, penalty, penalty * DOUBT)
    column = np.full(PLACES, -1, np.int64)
    column[used] = np.arange(len(used))
    picked = [c[c >= 0] for c in (column[r] for r in rows)]
    at = np.concatenate(picked)
    row = np.repeat(np.arange(len(rows)), [len(p) for p in picked])
    # grades are coded densely, so that a grade without rows has no threshold of its own
    y = np.searchsorted(there, grades)
    k = len(there) - 1

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.concatenate((p[:1], p[0] + np.cumsum(np.exp(p[1:]))))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = p[:-k], thresholds(p[-k:])
        s = np.bincount(row, w[at], minlength=len(rows))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        up, low = edge[y + 1] - s, edge[y] - s
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        a, b = np.where(np.isinf(up), 1.0, cdf(up)), np.where(np.isinf(low), 0.0, cdf(low))
        prob = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        g_w = np.bincount(at, (da - db)[row], minlength=len(w)) + held * w
        g_cut = np.array([-(da[y == j].sum() - db[y == j + 1].sum()) for j in range(k)])
        g_p = np.array([g_cut.sum(), *[np.exp(p[-k:][j]) * g_cut[j:].sum() for j in range(1, k)]])
        return float(-np.log(prob).sum() + (held * w) @ w / 2), np.concatenate((g_w, g_p))

    share = np.cumsum(np.bincount(y)[:-1]) / len(y)
    start = np.log(share / (1 - share))
    p = minimise(loss, np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(1e-3, np.diff(start))))))
    weights = np.zeros(PLACES, np.float32)
    weights[used] = p[:-k]
    cuts = np.full(GRADES - 1, -np.inf)
    for j in range(GRADES - 1):  # P(grade <= j) is the threshold of the highest grade there that is at most j
        below = int(np.searchsorted(there, j, side="right"))
        cuts[j] = -np.inf if below == 0 else np.inf if below > k else thresholds(p[-k:])[below - 1]
    return Model(weights, cuts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from a bounded sample of labelled documents: at most ``sample`` ids are joined to the texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("quality", _places)
        for batch in batches:
            yield pd.DataFrame({"grade": batch["grade"], "x": [features(t).tobytes() for t in batch["text"]]})

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    rows = texts.select("grade", "text").mapInPandas(run, "grade int, x binary").toPandas().sort_values(["grade", "x"])
    if not len(rows):
        return Model(np.zeros(PLACES, np.float32), np.zeros(0))
    return fit_ordinal([np.frombuffer(x, np.int32) for x in rows["x"]], rows["grade"].to_numpy())


RESULT = "expected_grade double, p_toxic double, p_good double, keep boolean"


def rating_column(model: Model, text: Column) -> Column:
    """A struct of RESULT for a text column."""

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_cache("quality", _places)
        for batch in batches:
            if not len(model.thresholds):
                tails = np.ones((len(batch), GRADES - 1))
            else:
                tails = model.tails(np.array([float(model.weights[features(t)].sum(dtype=np.float64)) for t in batch]))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1).round(6), "p_toxic": (1 - tails[:, 0]).round(6), "p_good": tails[:, -1].round(6), "keep": tails[:, -1] >= 0.5})

    return score(text)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected grade, tail probabilities and the decision for every document. No shuffle."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rating_column(model, text_or_empty()).alias("r")).select("doc_id", "r.*")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    prepare(docs.sparkSession)
    return docs.where(rating_column(model, text_or_empty())["keep"])
