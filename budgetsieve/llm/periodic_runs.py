"""Periodic runs of words: seeds on diagonals, extended to maximal runs and collapsed to one period.

A run is a stretch of consecutive words with smallest period q that is at least ``exponent`` periods
and ``least`` words long and that no neighbouring word extends. On the diagonal of lag q such a run is
a stretch of at least max(least - q, (exponent - 1) * q) places where words q apart are equal. Lags are
taken in bands whose largest lag isn't over the smallest of these overlaps, k: each run of a band then
has a repeated k-gram at its start, and because k >= q the next occurrence of that k-gram is exactly one
period on. So the index of k-grams gives each occurrence with the next one, never all pairs, and such a
seed has the smallest period by itself. k-grams are named exactly by doubling (no hashing), and only
places whose shorter gram repeats are named on, which for ordinary prose are few. A seed that lies in
what its lag has covered is skipped; any other is extended both ways and moves its lag's end of cover.

Texts are whole; null or empty texts and texts of white space have no words and no runs. Repeated rows
are each taken alone, in place, so that null ids, ties and clashing column names make no difference;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import crc32_sql, prepare, text_or_empty

LEAST, EXPONENT = 6, 4
#: Words of several texts that are indexed together; a longer text is taken alone.
GROUP_WORDS = 200_000

Run = tuple[int, int, int]


def bands(longest: int, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, k) up to the largest lag that a text of so many words can have."""
    low = 1
    while low * exponent <= longest:
        high, k = low, max(least - low, (exponent - 1) * low)
        while (more := min(k, max(least - high - 1, (exponent - 1) * (high + 1)))) >= high + 1:
            high, k = high + 1, more
            if high * exponent > longest:
                break
        yield low, high, k
        low = high + 1


class Grams:
    """Names of repeated grams by place, at lengths that double; -1 where a gram stands only once."""

    def __init__(self, ids: np.ndarray):
        self.named = {1: self._repeated(np.arange(len(ids)), ids, len(ids))}

    @staticmethod
    def _repeated(at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
        out = np.full(n, -1, np.int64)
        again = count[name] > 1
        out[at[again]] = name[again]
        return out

    def _joined(self, name: np.ndarray, step: int) -> np.ndarray:
        """Names of grams made of a gram and the one that starts ``step`` words on."""
        at = np.flatnonzero((name[:-step] >= 0) & (name[step:] >= 0)) if step < len(name) else np.zeros(0, np.int64)
        return self._repeated(at, name[at] * np.int64(len(name) + 1) + name[at + step], len(name))

    def of(self, k: int) -> np.ndarray:
        half = 1 << (k.bit_length() - 1)
        size = max(m for m in self.named if m <= half)
        while size < half:
            self.named[2 * size] = self._joined(self.named[size], size)
            size *= 2
        return self.named[half] if half == k else self._joined(self.named[half], k - half)


def _first_equal(ids: np.ndarray, i: int, lag: int) -> int:
    """The start of the equal places of a diagonal that hold place i."""
    step = 16
    while i:
        low = max(0, i - step)
        other = np.flatnonzero(ids[low:i] != ids[low + lag : i + lag])
        if len(other):
            return low + int(other[-1]) + 1
        i, step = low, 2 * step
    return i


def _past_equal(ids: np.ndarray, i: int, lag: int) -> int:
    """The end of the equal places of a diagonal that go up to place i."""
    step, last = 16, len(ids) - lag
    while i < last:
        high = min(last, i + step)
        other = np.flatnonzero(ids[i:high] != ids[i + lag : high + lag])
        if len(other):
            return i + int(other[0])
        i, step = high, 2 * step
    return i


def runs_of(ids: np.ndarray, longest: int, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of all runs, by start, then period.

    ``ids`` are the words of one text or of several in a row that share no id; ``longest`` is the
    largest number of words of one of them.
    """
    found, grams = [], Grams(ids)
    for low, high, k in bands(longest, least, exponent):
        name = grams.of(k)
        at = np.flatnonzero(name >= 0)
        if not len(at):
            break  # longer grams don't repeat either
        order = at[np.argsort(name[at], kind="stable")]
        lag = np.diff(order)
        seed = (name[order[1:]] == name[order[:-1]]) & (lag >= low) & (lag <= high)
        covered: dict[int, int] = {}
        for i, q in sorted(zip(order[:-1][seed].tolist(), lag[seed].tolist())):
            if i < covered.get(q, 0):
                continue
            start, end = _first_equal(ids, i, q), _past_equal(ids, i + k, q)
            covered[q] = end
            if end - start + q >= max(least, exponent * q):
                found.append((start, end - start + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> str:
    """The words without those that any run contains after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words).decode()


def runs_of_texts(texts: Sequence[str], least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, list[Run], str]]:
    """Number of words, runs and collapsed text of each; words are what ASCII white space separates."""

    def give(group: list[list[bytes]]) -> Iterator[tuple[int, list[Run], str]]:
        ids, ends, longest = [], [], 0
        base = 0
        for words in group:
            own: dict[bytes, int] = {}
            ids += [base + own.setdefault(w, len(own)) for w in words]
            base += len(own)
            ends.append(len(ids))
            longest = max(longest, len(words))
        runs = runs_of(np.array(ids, np.int64), longest, least, exponent)
        nth = np.searchsorted(ends, [r[0] for r in runs], side="right").tolist()
        own_runs: list[list[Run]] = [[] for _ in group]
        for t, (start, length, period) in zip(nth, runs):
            own_runs[t].append((start - ends[t] + len(group[t]), length, period))
        for words, mine in zip(group, own_runs):
            yield len(words), mine, collapsed(words, mine)

    group, size = [], 0
    for text in texts:
        words = text.encode().split()
        if group and size + len(words) > GROUP_WORDS:
            yield from give(group)
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield from give(group)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Adds n_words, runs (by start, then period) and collapsed, the text with each run cut to one period.

    ``exponent`` is 2 at least; from 3 on, the bands grow by that factor less one.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, *([r[i] for r in runs] for i in range(3)), kept) for n, runs, kept in runs_of_texts(texts.tolist(), least, exponent)]
        return pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    made = docs.withColumn("__found", find(text_or_empty(text)))
    runs = F.arrays_zip(F.col("__found.starts").alias("start"), F.col("__found.lengths").alias("length"), F.col("__found.periods").alias("period")).cast(RUNS)
    return made.withColumns({"n_words": F.col("__found.n_words"), "runs": runs, "collapsed": F.col("__found.collapsed")}).drop("__found")


def collapse(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The documents with each run cut to one period, with all their columns; texts without a run stay as they are."""
    found = find_runs(docs.withColumn("__text", F.col("text")), "__text", least, exponent)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text"))
    out = found.withColumn("__new", text)
    names = {c: F.col(f"`{c}`") for c in docs.columns}
    names["text"] = F.col("__new")
    if "n_chars" in names:
        names["n_chars"] = F.when(F.size("runs") > 0, F.char_length("__new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in names.items()])


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id) is divisible by ten, the words from g % n on repeat their first ones, g = h // 10.

    The others keep their text, and so do rows without an id.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_or_empty(), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    picked = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = picked.withColumn("a", (F.col("g") % F.greatest(n, F.lit(1))).cast("int")).withColumn("rest", n - F.col("a"))
    placed = placed.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    first = F.slice("words", F.lit(1), F.col("a"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.greatest(F.col("rest"), F.lit(0)))
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(F.concat(first, again), " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the strongest of them, and digests of the runs and of the collapsed text."""
    found = find_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The same result in SQL: all pairs of equal words of a document, joined up along diagonals.
SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS k, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM cut),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized),
dealt AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + coalesce(g, 0) % 8) END AS p FROM placed),
words AS (SELECT k, i, ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM dealt)),
coded AS (SELECT k, i, min(i) OVER (PARTITION BY k, w) AS w FROM words),
equal AS (SELECT x.k, x.i, y.i - x.i AS q FROM coded x JOIN coded y ON x.k = y.k AND x.w = y.w AND y.i > x.i JOIN dealt d ON d.k = x.k AND 4 * (y.i - x.i) <= d.n),
stretch AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS o FROM equal),
long AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM stretch GROUP BY k, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.k = r.k AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
each AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY k),
best AS (SELECT k, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l::DECIMAL(18, 0) / q::DECIMAL(18, 0) DESC, s, q) AS nth FROM runs) WHERE nth = 1),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT d.doc_id, coalesce(e.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
    sha256(coalesce(e.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM dealt d LEFT JOIN each e ON e.k = d.k LEFT JOIN best b ON b.k = d.k LEFT JOIN kept ON kept.k = d.k
"""
