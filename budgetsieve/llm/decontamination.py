"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each benchmark item gives its windows of ten consecutive words; an item of fewer words is one
window. Windows of equal length form one matcher: a shift table over blocks of two words says how
far the search may jump, blocks that end a window select its bucket, the window's first block
narrows the bucket, and direct comparison confirms. The benchmark is a stated query set: it is
taken in blocks of bounded size, each block in a pass of its own against all documents; between passes
the documents' hits so far are written to the shared folder.

Null and empty texts have no words; such items have no windows. Repeated items with one item_id
count once. Repeated documents stay separate rows. Empty tables give empty results (no items: no
hits). Extra columns are ignored by :func:`contamination` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import materialise, own_cache, prepare, text_or_empty

WINDOW = 10
#: Bytes of benchmark text that one pass sends to the executors.
BLOCK_BYTES = 16 << 20

#: Bytes to word characters: A-Z lower-cased, other ASCII that isn't a letter or digit to a space.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Finds equal-length sequences of word numbers; number 0 stands for any word of no sequence."""

    def __init__(self, patterns: dict[tuple[int, ...], list[int]], length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[tuple[int, ...], list[int]]]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            last, head = self._key(pattern, length - 1), self._key(pattern, self.block - 1)
            self.buckets.setdefault(last, {}).setdefault(head, []).append((pattern, owners))

    def _key(self, ids, at: int) -> int:
        return ids[at] if self.block == 1 else (ids[at - 1] << 32) | ids[at]

    def find(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """The start of each occurrence and the pattern's owners."""
        n, length, jump, get, two = len(ids), self.length, self.jump, self.shift.get, self.block == 2
        at = length - 1
        while at < n:
            last = ids[at]
            if not last:
                at += length
                continue
            key = (ids[at - 1] << 32) | last if two else last
            step = get(key, jump)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, owners in self.buckets[key].get(self._key(ids, start + self.block - 1), ()):
                if tuple(ids[start : at + 1]) == pattern:
                    yield start, owners
            at += 1


class Benchmark:
    """The matchers of some items, one for each window length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names: list[str] = []
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            owner = len(self.names)
            self.names.append(str(item_id))
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                owners = by_length.setdefault(length, {}).setdefault(ids[i : i + length], [])
                if not owners or owners[-1] != owner:
                    owners.append(owner)
        self.matchers = [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence, and the items that occur."""
        get = self.numbers.get
        ids = [get(w, 0) for w in words]
        edges, items = np.zeros(len(ids) + 1, np.int64), set()
        for matcher in self.matchers:
            for start, owners in matcher.find(ids):
                edges[start] += 1
                edges[start + matcher.length] -= 1
                items.update(owners)
        return np.cumsum(edges[:-1]) > 0, {self.names[k] for k in items}


def blocks(benchmark: DataFrame) -> int:
    """How many blocks of bounded size the items make."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size // BLOCK_BYTES + 1


def items_of(benchmark: DataFrame, block: int, n: int) -> list[tuple]:
    """The items of one block."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    return [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).collect()]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words hit so far, a bit each, and the items.
HITS = "hit binary, items array<string>"


def _summary(n_words: int, hit: np.ndarray, items: set[str]) -> tuple:
    n = int(hit.sum())
    return n_words, n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0


def _scan(spark, items: list[tuple], window: int):
    """The result of one block that is the whole benchmark."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_cache("decontamination", {})
        matcher = Benchmark(sent.value, window)
        for batch in batches:
            each = [words_of(t) for t in batch]
            yield pd.DataFrame([_summary(len(w), *matcher.search(w)) for w in each], columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return scan


def _scan_more(spark, items: list[tuple], window: int):
    """The hits of a block beside those of the blocks before."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own_cache("decontamination", {})
        matcher = Benchmark(sent.value, window)
        for texts, hits, names in batches:
            rows = []
            for t, h, before in zip(texts, hits, names):
                words = words_of(t)
                hit, found = matcher.search(words)
                hit |= np.unpackbits(np.frombuffer(h, np.uint8))[: len(words)].astype(bool) if h else False
                rows.append((np.packbits(hit).tobytes(), sorted(found | set(before))))
            yield pd.DataFrame(rows, columns=["hit", "items"])

    return scan


def _summed_up(texts: pd.Series, hits: pd.Series, names: pd.Series) -> pd.DataFrame:
    rows = []
    for t, h, items in zip(texts, hits, names):
        n = len(words_of(t))
        rows.append(_summary(n, np.unpackbits(np.frombuffer(h, np.uint8))[:n], set(items)))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def judged(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW) -> DataFrame:
    """The documents with a struct of RESULT under a name. No shuffle; one pass for each block."""
    spark = docs.sparkSession
    prepare(spark)
    n = blocks(benchmark)
    if n == 1:
        return docs.withColumn(name, _scan(spark, items_of(benchmark, 0, 1), window)(text_or_empty()))
    state = docs.withColumn(name, F.struct(F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items")))
    for block in range(n):
        scan = _scan_more(spark, items_of(benchmark, block, n), window)
        state = materialise(state.withColumn(name, scan(text_or_empty(), F.col(name)["hit"], F.col(name)["items"])), "hits")
    return state.withColumn(name, F.pandas_udf(_summed_up, RESULT)(text_or_empty(), F.col(name)["hit"], F.col(name)["items"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its words, its words inside occurrences and the items that occur."""
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "__r", window).select("doc_id", "__r.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    return judged(docs, benchmark, "__r", window).where(~F.col("__r")["contaminated"]).select(*docs.columns)


#: The same result in SQL, for small tables.
SQL = """
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(w[i : i + least(10, len(w)) - 1]) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
sizes AS (SELECT DISTINCT m FROM windows),
spots AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM docs, sizes WHERE len(w) >= m)),
found AS (SELECT spots.doc_id, spots.m, spots.i, windows.item_id FROM spots JOIN windows USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
