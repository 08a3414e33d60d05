"""N-gram Jaccard join with PartEnum signatures.

Documents with equal sets of word n-grams form classes; the smallest doc_id stands for its class.
Sets are signed (see :class:`PartEnum`), and only signatures that two different sets share go on.
Links are confirmed on the whole sets, in steps that together lose no link between components:

1. In every bucket one member leads. Each document is compared with the leader that it shares most
   signatures with; confirmed links give first components.
2. What is left are pairs that share a bucket and lie in different components. A bucket is crowded where
   these are more than ``CROSS`` a member. Members of crowded buckets are compared with leaders drawn
   anew from a few of their buckets (:func:`drawn_buckets`), which joins a group of near copies in a few
   rounds of as many pairs as it has members.
3. All cross pairs of buckets that aren't crowded are compared. Members of those that still are sign once
   more with finer parts, listed from the rarest (counted over these documents) to the most common, so
   that what a loose group has in common isn't what its members are compared by. Pairs whose profiles
   (counts of n-grams in ranges of hashes) already differ too much can't be links and are never made.

Null texts and texts without words have empty sets and are linked with nothing. Repeated rows of one
doc_id count as one document when their sets are equal. Empty tables give empty ones; extra columns are
ignored by :func:`link` and kept by :func:`keep_one`. Ties need no rule: ids are the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.llm.common import materialise, own_cache, prepare, text_or_empty
from budgetsieve.llm.components import components
from budgetsieve.llm.ngram_sets import PartEnum, jaccard_at_least, ngrams, word_hashes

#: Cross pairs a member up to which a bucket gives its pairs directly.
CROSS = 3
#: Rounds of drawn leaders, how many a bucket has in one, and in how many buckets and with how many a document is compared.
ROUNDS, LEADERS, COMPARED = 2, 3, 8
#: Ranges of hashes in a set's profile, as a power of two; counts fit a byte.
PROFILE_BITS, MOST = 7, 127
#: Finer parts for each one that must meet.
SPREAD = 2
#: Sets whose signatures a task remembers to have given.
REMEMBERED = 1_000_000


def digest_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, digest of the set and node: 64 bits of the digest, the same for equal sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("ngrams", word_hashes)
        for batch in batches:
            sets = [ngrams(t, width) for t in batch["text"]]
            digests = [digest_of(s) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digests, "node": [node_of(d) for d in digests]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInPandas(run, "doc_id long, n_shingles long, digest binary, node long")


def signatures_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, node) of each set; a task gives those of equal sets once, so that copies don't crowd the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("ngrams", word_hashes)
        scheme, seen = PartEnum(percent / 100), set()
        for batch in batches:
            nodes, signatures = [], []
            for text in batch["text"]:
                items = ngrams(text, width)
                node = node_of(digest_of(items))
                if node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                signatures.append(scheme.sign(items).view(np.int64))
            if nodes:  # a batch may hold copies alone
                yield pd.DataFrame({"node": nodes, "signatures": signatures})

    return docs.select(text_or_empty().alias("text")).mapInPandas(run, "node long, signatures array<long>").select(F.explode("signatures").alias("signature"), "node")


def shared_signatures(each: DataFrame) -> DataFrame:
    """Rows (signature, node, leader) of signatures that two nodes share; the smallest node leads."""
    same = Window.partitionBy("signature")
    ends = each.withColumns({"leader": F.min("node").over(same), "high": F.max("node").over(same)})
    return ends.where(F.col("leader") < F.col("high")).select("signature", "node", "leader")


def alike(percent: int) -> Column:
    """Whether sets with sizes na, nb and profiles pa, pb may be similar enough.

    Sets of sizes m and n are similar enough only if they differ in at most (100 - p) / (100 + p) of
    m + n elements, and they differ in at least the sum of their profiles' differences (counts that were
    cut off differ by less).
    """
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("ngrams", word_hashes)
        last, held = None, None
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ta"], batch["tb"]):
                if a != last:
                    last, held = a, ngrams(ta, width)
                if jaccard_at_least(held, ngrams(tb, width), percent):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    joined = pairs.join(left, "a").join(right, "b").where(alike(percent)).select("a", "b", "ta", "tb")
    return joined.sortWithinPartitions("a").mapInPandas(run, "a long, b long")


def rare_signatures(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, id): finer parts, the rarest first, as many as must meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("ngrams", word_hashes)
        scheme = PartEnum(percent / 100)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].tolist(), batch["text"]):
                items = ngrams(text, width)
                own = scheme.band(len(items))
                for band in (own, own + 1) if len(items) else ():
                    names, filled, must = scheme.listing(items, band, SPREAD)
                    rows.append((i, band, must, names.view(np.int64), filled == 0))
            yield pd.DataFrame(rows, columns=["id", "band", "must", "signature", "empty"])

    listed = materialise(texts.mapInPandas(run, "id long, band int, must int, signature array<long>, empty array<boolean>"), "fine-parts")
    parts = listed.select("id", "band", "must", F.explode(F.arrays_zip("signature", "empty")).alias("part")).select("id", "band", "must", "part.*")
    counts = parts.groupBy("signature").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    order = Window.partitionBy("id", "band").orderBy("empty", F.coalesce("df", F.lit(1)), "signature")
    ranked = parts.join(counts, "signature", "left").withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("place") <= F.col("must")) & F.col("df").isNotNull()).select("signature", "id").distinct()


def profiled(texts: DataFrame, width: int) -> DataFrame:
    """Adds a text's set size and how many of its n-grams fall into each range of hashes, MOST at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_cache("ngrams", word_hashes)
        for batch in batches:
            sets = [ngrams(t, width) for t in batch["text"]]
            batch["n"] = [len(s) for s in sets]
            batch["profile"] = [np.minimum(np.bincount((s >> np.uint64(64 - PROFILE_BITS)).astype(np.int64), minlength=1 << PROFILE_BITS), MOST).astype(np.int8) for s in sets]
            yield batch

    return texts.mapInPandas(run, "id long, text string, n long, profile array<tinyint>")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (signature, id) of buckets whose members lie in more than one component, with each member's.

    Adds the component of most members (main) and the pairs of different components a member (cross).
    """
    marked = buckets.select("signature", "id").join(labels.select("id", F.col("component").alias("c")), "id", "left").select("signature", "id", F.coalesce("c", "id").alias("component"))
    kinds = marked.groupBy("signature", "component").agg(F.count("*").alias("k")).groupBy("signature")
    kinds = kinds.agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("within"))
    # written first, so that the join is one that adaptive execution can split
    kinds = materialise(kinds.where("parts > 1").select("signature", "main", ((F.col("size") * F.col("size") - F.col("within")) / (2 * F.col("size"))).alias("cross")), "bucket-kinds")
    return marked.join(kinds, "signature")


def drawn_buckets(buckets: DataFrame, seed: int) -> DataFrame:
    """Each member's COMPARED first buckets in one drawn order of all buckets.

    Near copies share most of their buckets, so that they come first to the same ones; what isn't linked
    in these stays in its other buckets and is compared there later.
    """
    first = Window.partitionBy("id").orderBy(F.xxhash64("signature", F.lit(seed)), "signature")
    return buckets.select("signature", "id", "component").withColumn("place", F.row_number().over(first)).where(F.col("place") <= COMPARED).drop("place")


def drawn_pairs(buckets: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of a member and a leader of its drawn buckets, in different components.

    Leaders come first in one drawn order of all ids, so that a document meets some of them often; it is
    compared with those that it shares most signatures with.
    """
    buckets = materialise(drawn_buckets(buckets, seed), "drawn-buckets")
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "component")
    # the first by aggregation, which keeps so many rows of a bucket in each task
    drawn = buckets.groupBy("signature").agg(*[F.min(F.when(F.pmod(F.xxhash64("id", F.lit(-1 - seed)), F.lit(LEADERS)) == k, order)).alias(f"l{k}") for k in range(LEADERS)])
    drawn = drawn.select("signature", F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("l")).where(F.col("l").isNotNull())
    drawn = materialise(drawn.select("signature", F.col("l.id").alias("a"), F.col("l.component").alias("ca")), "leaders")
    met = buckets.join(drawn, "signature").where(F.col("component") != F.col("ca")).groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n"))
    most = Window.partitionBy("b").orderBy(F.desc("n"), F.xxhash64("a", "b"), "a")
    return met.withColumn("place", F.row_number().over(most)).where(F.col("place") <= COMPARED).select("a", "b")


def cross_pairs(buckets: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one bucket that lie in different components and may be similar.

    One of them isn't in the bucket's main component; these meet all of its members.
    """
    each = buckets.select("signature", "id", "component", "main").join(profiles.select("id", "n", "profile"), "id")
    one = each.where("component <> main").select("signature", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    two = each.select("signature", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("nb"), F.col("profile").alias("pb"), (F.col("component") == F.col("main")).alias("in_main"))
    may = (one["signature"] == two["signature"]) & (F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & alike(percent)
    return one.join(two, may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included)."""
    prepare(docs.sparkSession)
    signed = materialise(set_sizes(docs, width), "set-sizes")
    shared = materialise(shared_signatures(signatures_of(docs, width, percent)), "met")
    classes = materialise(signed.where(F.col("n_shingles") > 0).groupBy("digest", "node").agg(F.min("doc_id").alias("id")), "classes")
    buckets = materialise(shared.join(classes.select("node", "id"), "node").select("signature", "id").distinct(), "buckets")

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("text").isNotNull())
    text = F.first("text").alias("text")  # repeated rows of one doc_id
    texts = materialise(profiled(picked.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(text), width), "texts")

    most = Window.partitionBy("node").orderBy(F.desc("n"), "leader")
    stars = shared.where(F.col("node") != F.col("leader")).groupBy("leader", "node").agg(F.count("*").alias("n"))
    stars = stars.withColumn("place", F.row_number().over(most)).where("place = 1").select("leader", "node")
    stars = stars.join(classes.select(F.col("node").alias("leader"), F.col("id").alias("a")), "leader").join(classes.select("node", F.col("id").alias("b")), "node").select("a", "b")
    edges = materialise(confirm(stars, texts, width, percent), "links")
    labels = components(edges)
    left = materialise(open_buckets(buckets, labels), "open-buckets")
    crowded = left.where(F.col("cross") > CROSS)
    for seed in range(ROUNDS):
        if crowded.isEmpty():
            break
        edges = edges.unionByName(materialise(confirm(drawn_pairs(crowded, seed), texts, width, percent), "links"))
        labels = components(edges)
        left = materialise(open_buckets(left, labels), "open-buckets")
        crowded = left.where(F.col("cross") > CROSS)

    pairs = cross_pairs(left.where(F.col("cross") <= CROSS), texts, percent)
    if not crowded.isEmpty():
        members = texts.select("id", "text").join(crowded.select("id").distinct(), "id", "left_semi")
        fine = materialise(open_buckets(rare_signatures(members, width, percent), labels), "open-buckets")
        pairs = pairs.unionByName(cross_pairs(fine, texts, percent)).distinct()
    more = materialise(confirm(pairs, texts, width, percent), "links")

    final = components(edges.unionByName(more))
    of_class = classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    named = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    return named.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    linked = link(docs, width, percent)
    lost = linked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(lost, docs["doc_id"] == F.col("__doc"), "left_anti").select(*docs.columns)


#: The same result in SQL, for small tables.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') || CASE WHEN len(w) < 3 THEN chr(10) ELSE '' END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
