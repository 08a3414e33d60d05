"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

The state has three tables in the shared folder. *Postings* hold each document's distinct line keys;
*references* hold each key's number of documents and its first document, exactly; *filters* hold one
cuckoo filter a shard with the keys of two or more documents. A document's lines ask the filters
first and only hits go to the exact table, so that lines found once (most of them) never reach a join.
Insertions add to all three; deletions of documents take postings away, lower the counts, find the
next first document and delete fingerprints, so that a deletion undoes its insertion.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys of fewer than
ten code points are never dropped. Null and empty texts are one empty line. Documents are told apart
by doc_id, so that repeated rows of one doc_id count once and lose nothing to each other. Empty tables
give empty ones; extra columns are ignored by :func:`report` and kept by :func:`drop_lines`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetsieve.llm.common import materialise, own_cache, prepare, text_or_empty

LEAST = 10
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Postings that one task looks up at a time.
GROUP_ROWS = 50_000


def key_of(line: str, least: int = LEAST) -> bytes | None:
    """The 128-bit name of a line's key, or None if the key is too short to be dropped."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.translate(_LOWER) if not key.isascii() else key.lower()) if len(key) >= least else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; inserted in rounds over whole arrays, deletable."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, n) / 3.2)))), 4), np.uint16))

    def _at(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (names >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        return prints.astype(np.uint16), names & self.mask

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & self.mask)

    def insert(self, names: np.ndarray) -> bool:
        """Adds distinct names; False when the table is too full, which leaves it unusable."""
        prints, bucket = self._at(names)
        for turn in range(400):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = self.table[bucket] == 0
            nth = (np.cumsum(free, axis=1) == rank[:, None] + 1) & free
            fits = nth.any(axis=1)
            self.table[bucket[fits], nth[fits].argmax(axis=1)] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if not turn:
                bucket = self._other(prints, bucket)
            elif len(prints):  # one for each full bucket takes another's place, which moves on
                _, first = np.unique(bucket, return_index=True)
                slot = (turn + prints[first]) % 4
                out = self.table[bucket[first], slot]
                self.table[bucket[first], slot] = prints[first]
                prints[first] = out
                bucket[first] = self._other(out, bucket[first])
        return False

    def contains(self, names: np.ndarray) -> np.ndarray:
        prints, bucket = self._at(names)
        same = prints[:, None]
        return (self.table[bucket] == same).any(axis=1) | (self.table[self._other(prints, bucket)] == same).any(axis=1)

    def delete(self, names: np.ndarray) -> None:
        """Takes distinct names away that were inserted."""
        prints, bucket = self._at(names)
        for p, one, two in zip(prints, bucket, self._other(prints, bucket)):
            for b in (one, two):
                slot = np.flatnonzero(self.table[b] == p)
                if len(slot):
                    self.table[b, slot[0]] = 0
                    break


def names_of(keys: pd.Series) -> np.ndarray:
    """64 bits of each 128-bit key, apart from those that choose the shard."""
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def postings_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and each distinct key of its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("line_dedup", {})
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                found = {key_of(x, least) for x in text.split("\n")} - {None}
                ids += [doc_id] * len(found)
                keys += found
            yield pd.DataFrame({"doc_id": ids, "key": keys})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.col("doc_id").isNotNull())
    return picked.mapInPandas(run, "doc_id long, key binary").dropDuplicates(["doc_id", "key"])


FILTERS = "shard int, n long, buckets binary"


class LineIndex:
    """The state of incremental line dedup; every change gives a new state and leaves the old one."""

    def __init__(self, spark: SparkSession, shards: int | None = None):
        prepare(spark)
        self.spark = spark
        self.shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.postings = self.references = self.filters = None

    def _next(self, postings: DataFrame, references: DataFrame) -> LineIndex:
        new = LineIndex(self.spark, self.shards)
        new.postings, new.references = postings, references
        return new

    def save(self, path: str) -> None:
        """Writes the three tables under a path that another session may open."""
        for name in ("postings", "references", "filters"):
            getattr(self, name).withColumn("shards", F.lit(self.shards)).write.parquet(f"{path}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The state that was saved under a path."""
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "references", "filters")}
        first = tables["references"].select("shards").first()
        index = cls(spark, first["shards"] if first else None)
        for name, table in tables.items():
            setattr(index, name, table.drop("shards"))
        return index

    def insert(self, docs: DataFrame, least: int = LEAST) -> LineIndex:
        """The state with further documents; documents already there count once."""
        added = postings_of(docs, least)
        if self.postings is None:
            postings = materialise(added, "line-postings")
            counted = postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
            new = self._next(postings, materialise(counted.withColumn("shard", shard_of(F.col("key"), self.shards)), "line-references"))
            new.filters = new._build(None)
            return new
        added = materialise(added.join(self.postings, ["doc_id", "key"], "left_anti"), "line-postings")
        counted = added.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).withColumn("shard", shard_of(F.col("key"), self.shards))
        both = self.references.unionByName(counted).groupBy("key", "shard").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))
        new = self._next(self.postings.unionByName(added), materialise(both.select("key", "n_docs", "first_doc", "shard"), "line-references"))
        new.filters = new._build(self)
        return new

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The state without some documents (doc_id), as if they had never been inserted."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        touched = self.postings.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("less"))
        left = materialise(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        again = left.join(touched, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("next_doc"))
        lowered = self.references.join(touched, "key", "left").join(again, "key", "left").where(F.col("n_docs") > F.coalesce("less", F.lit(0)))
        references = lowered.select("key", (F.col("n_docs") - F.coalesce("less", F.lit(0))).alias("n_docs"), F.when(F.col("less").isNull(), F.col("first_doc")).otherwise(F.col("next_doc")).alias("first_doc"), "shard")
        new = self._next(left, materialise(references, "line-references"))
        new.filters = new._build(self)
        return new

    def _build(self, old: LineIndex | None) -> DataFrame:
        """One filter a shard; keys that have come or gone change the old filter if it has the room."""
        now = self.references.where(F.col("n_docs") >= 2).select("shard", "key", F.lit(1).alias("change"))
        if old is not None:
            was = old.references.where(F.col("n_docs") >= 2).select("shard", "key")
            now = now.join(was.withColumn("was", F.lit(1)), ["shard", "key"], "full").select("shard", "key", F.when(F.col("was").isNull(), 1).when(F.col("change").isNull(), -1).otherwise(0).alias("change"))

        def build(shard: tuple, keys: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            names, change = names_of(keys["key"]), keys["change"].to_numpy()
            n = int((change >= 0).sum())
            made = None
            if len(before):
                made = CuckooFilter(np.frombuffer(before["buckets"].iloc[0], np.uint16).reshape(-1, 4).copy())
                made.delete(names[change < 0])
                if n > 3.6 * len(made.table) or not made.insert(names[change > 0]):
                    made = None
            size = n
            while made is None:
                made = CuckooFilter.sized(size)
                if not made.insert(names[change >= 0]):
                    made, size = None, 2 * size
            return pd.DataFrame({"shard": [shard[0]], "n": [n], "buckets": [made.table.tobytes()]})

        held = old.filters if old is not None else self.spark.createDataFrame([], FILTERS)
        return materialise(now.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(build, FILTERS), "line-filters")

    def dropped(self, postings: DataFrame | None = None) -> DataFrame:
        """doc_id and the keys whose lines it loses: those of an earlier document as well.

        Shards that hold hot lines are salted by doc_id in proportion to their postings, with a copy
        of the shard's small filter for each salt; hits alone are joined to the exact table.
        """
        postings = self.postings if postings is None else postings
        # one row a shard
        load = self.references.groupBy("shard").agg((F.sum("n_docs") / GROUP_ROWS).cast("int").alias("more"))
        keyed = postings.withColumn("shard", shard_of(F.col("key"), self.shards)).join(F.broadcast(load), "shard")
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("more") + 1).cast("int")).drop("more")
        copies = self.filters.join(F.broadcast(load), "shard").select("shard", F.explode(F.sequence(F.lit(0), "more")).alias("salt"), "buckets")

        def probe(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(held):
                return rows[["doc_id", "key"]].head(0)
            found = CuckooFilter(np.frombuffer(held["buckets"].iloc[0], np.uint16).reshape(-1, 4)).contains(names_of(rows["key"]))
            return rows.loc[found, ["doc_id", "key"]]

        hits = keyed.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "doc_id long, key binary")
        exact = self.references.where(F.col("n_docs") >= 2).select("key", "first_doc")
        return hits.join(exact, "key").where(F.col("doc_id") > F.col("first_doc")).groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))


def _kept(text: str, dropped, least: int) -> tuple[list[str], int]:
    lines = text.split("\n")
    if dropped is None or not len(dropped):
        return lines, len(lines)
    gone = set(map(bytes, dropped))
    return [x for x in lines if key_of(x, least) not in gone], len(lines)


def report(docs: DataFrame, index: LineIndex | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, its lines, how many it loses and the digest of what it keeps."""
    index = index or LineIndex(docs.sparkSession).insert(docs, least)

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def count(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, dropped):
            kept, n = _kept(t, d, least)
            rows.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(index.dropped(), "doc_id", "left")
    return joined.select("doc_id", count("text", "dropped").alias("r")).select("doc_id", "r.*")


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without the lines they lose, with all their columns; n_chars, if there, follows the text."""
    index = LineIndex(docs.sparkSession).insert(docs, least)

    @F.pandas_udf("string")
    def keep(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(_kept(t, d, least)[0]) for t, d in zip(texts, dropped)], dtype=object)

    gone = index.dropped().select(F.col("doc_id").alias("__doc"), F.col("dropped").alias("__dropped"))
    joined = docs.join(gone, F.col("doc_id") == F.col("__doc"), "left")
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(keep(text_or_empty(), "__dropped"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: The same result in SQL.
SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
found AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM keyed k LEFT JOIN found f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
