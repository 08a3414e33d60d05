"""Suffix-array dedup by a distributed difference-cover algorithm.

Every byte covered by a 100-byte string that also starts earlier is removed. The sort of all suffixes
is cut into independent ones first, without losing a repeat:

1. Each 100-byte string has an anchor: the 32-byte window in it with the smallest hash, leftmost among
   equals. Equal strings have equal anchors at equal offsets, so that strings of different anchor
   classes never meet. Consecutive starts with one anchor form a cell. Classes with a single cell in
   the whole corpus hold no repeats; they are counted out (partial counts first) and go.
2. The remaining cells' segments (starts and 99 bytes more) are read from the texts. A task drops a
   segment that it has seen in an earlier document at once: all its strings are repeats.
3. Segments meet by class. There the difference-cover sort runs: triples at positions 1 and 2 modulo 3
   are sorted and named, the names are sorted by recursion, the remaining suffixes are sorted by their
   first symbol and the next rank and merged. Recursion ends when names cover 100 bytes. Adjacent
   suffixes are compared over 100 bytes; in each group of equals the first start stays.

A class of very many cells (a passage that a third of all documents hold) is dealt anew by the strings
themselves, so that no task holds it whole.

Null and empty texts have no bytes; texts under 100 bytes lose nothing. doc_id tells documents apart;
repeated rows of one doc_id with equal text count as one document and get equal results (rows of one
doc_id with different texts must not be: they would share the ranges of one). Rows without a doc_id are
left out. Empty tables give empty ones; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import materialise, prepare, text_or_empty

LENGTH, ANCHOR = 100, 32
#: Cells from which a class is dealt by strings; bytes of segments that one sort takes.
CROWDED, SORT_BYTES = 8_000, 1_500_000
#: Starts whose anchors are found at a time: positions fit the low bits of a sort key.
STRETCH, LOW_BITS = 200_000, 18
REMEMBERED = 400_000


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` bytes (a power of two)."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = 1
    while n < width:
        h = h[:-n] * np.uint64(0xBF58476D1CE4E5B9) + h[n:] * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def cells_of(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and number of starts of each cell."""
    names, firsts, sizes = [], [], []
    data = np.frombuffer(text, np.uint8)
    low = np.uint64((1 << LOW_BITS) - 1)
    windows = length - anchor + 1
    for base in range(0, len(data) - length + 1, STRETCH):
        h = window_hashes(data[base : base + STRETCH + length - 1], anchor)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= windows:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < windows:
            key = np.minimum(key[: n - windows], key[windows - n :])
        at = (key & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        names.append(h[at[first]])
        firsts.append(base + first)
        sizes.append(np.diff(np.append(first, len(at))))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(firsts), np.concatenate(sizes)


def _dense(key: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... in the order of the keys; equal keys share a name."""
    if len(key) and int(key.max()) < 1 << 24:
        there = np.zeros(int(key.max()) + 1, np.uint64)
        there[key] = 1
        return np.cumsum(there, dtype=np.uint64)[key]
    order = np.argsort(key)
    ranked = key[order]
    names = np.empty(len(key), np.uint64)
    names[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])), dtype=np.uint64)
    return names


def suffix_order(symbols: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and ranks (equal where the order can't tell).

    Suffixes are told apart over at least their first ``need`` symbols; symbols are positive. Lengths
    up to about three million keep every key within 64 bits.
    """
    n = len(symbols)
    t = np.concatenate((symbols.astype(np.uint64), np.zeros(4, np.uint64)))
    top = t.max() + np.uint64(1)
    # a position past the end joins class 1 if n is 1 modulo 3, so that names of classes don't run together
    one, two = np.arange(1, 3 * ((n + 2) // 3) + 1, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    name = _dense((t[sample] * top + t[sample + 1]) * top + t[sample + 2])
    if need > 3 and int(name.max(initial=0)) < len(sample):
        _, name = suffix_order(name, -(-need // 3) + 1)
    rank = np.zeros(n + 4, np.uint64)
    rank[sample] = name
    size = rank.max() + np.uint64(1)

    rest = np.arange(0, n, 3)
    first = t[rest] * size + rank[rest + 1]
    by_first = np.argsort(first)
    rest, first = rest[by_first], first[by_first]
    sample = sample[np.argsort(name)]
    sample = sample[sample < n]
    s1, s2 = sample[sample % 3 == 1], sample[sample % 3 == 2]
    second = (t[rest] * top + t[rest + 1]) * size + rank[rest + 2]
    # where names tie, either order of a class will do; sorted keys count alike
    below1 = np.searchsorted(np.sort(t[s1] * size + rank[s1 + 1]), first)
    below2 = np.searchsorted(np.sort((t[s2] * top + t[s2 + 1]) * size + rank[s2 + 2]), second)
    before = below1 + np.maximum.accumulate(below2)
    place = np.arange(len(rest)) + before
    order = np.empty(n, np.int64)
    merged = np.zeros(n, bool)
    merged[place] = True
    order[place] = rest
    order[~merged] = sample

    p, q = order[:-1], order[1:]
    same = (rank[p] == rank[q]) & (p % 3 != 0) & (q % 3 != 0)
    mixed = (p % 3 == 0) | (q % 3 == 0)
    with_two = (p % 3 == 2) | (q % 3 == 2)
    same |= mixed & ~with_two & (t[p] == t[q]) & (rank[p + 1] == rank[q + 1])
    same |= mixed & with_two & (t[p] == t[q]) & (t[p + 1] == t[q + 1]) & (rank[p + 2] == rank[q + 2])
    ranks = np.empty(n, np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([n > 0], ~same)), dtype=np.uint64)
    return order, ranks


def repeats(segments: list[bytes], starts: list[int], doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which starts of the segments have an equal string that starts earlier in (doc, position).

    Segment k holds starts[k] strings of document doc[k] from at[k] on. Flags come in the order of
    segments and starts.
    """
    sizes = np.array([len(s) + 1 for s in segments])
    data = np.frombuffer(b"\0".join(segments) + b"\0" * 8, np.uint8)
    base = np.cumsum(sizes) - sizes
    n_starts = np.array(starts)
    valid = np.repeat(base - (np.cumsum(n_starts) - n_starts), n_starts) + np.arange(int(n_starts.sum()))
    owner = np.repeat(np.arange(len(segments)), n_starts)
    where = at[owner] + (valid - base[owner])
    symbols = data[: int(sizes.sum())].astype(np.uint64) + np.uint64(1)
    order, _ = suffix_order(symbols, length)
    flag_of = np.full(len(symbols), -1, np.int64)
    flag_of[valid] = np.arange(len(valid))
    kept = order[flag_of[order] >= 0]
    # adjacent prefixes: eight bytes at a time, where all before were equal
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words[: len(symbols)]).view("<u8").reshape(-1) if len(symbols) < 1 << 16 else _words(data, len(symbols))
    pair = np.arange(len(kept) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        pair = pair[words[kept[pair] + k] == words[kept[pair + 1] + k]]
    new = np.ones(len(kept), bool)
    new[pair + 1] = False
    group = np.cumsum(new) - 1
    flags = flag_of[kept]
    by_place = np.lexsort((where[flags], doc[owner[flags]], group))
    first = np.diff(group[by_place], prepend=-1) != 0
    out = np.ones(len(valid), bool)
    out[flags[by_place[first]]] = False
    return out


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each position on as one integer."""
    w = data[: n + 7].astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        w = w[:-step] | (w[step:] << np.uint64(shift))
    return w[:n]


PIECES = "key long, doc_id long, start long, n int, segment binary"


def anchor_cells(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The cells of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [cells_of(t.encode(), length) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "names": [f[0].view(np.int64) for f in found], "cells": [(f[1] << 8) | f[2] for f in found]})

    return docs.mapInPandas(run, "doc_id long, names array<long>, cells array<long>")


def pieces(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (doc_id, text, cells) the segments that must be sorted, and runs (no segment) that are repeats already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        last = None
        for batch in batches:
            rows = []
            for doc_id, text, cells in zip(batch["doc_id"].tolist(), batch["text"], batch["cells"]):
                if doc_id == last:  # a repeated row
                    continue
                last, raw = doc_id, text.encode()
                for cell in sorted(cells, key=lambda c: c["cell"]):
                    first, n = cell["cell"] >> 8, cell["cell"] & 255
                    if first + n + length - 1 > len(raw):
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    parts = [(first, n, cell["name"])] if not cell["crowded"] else [(first + i, 1, None) for i in range(n)]
                    for start, size, key in parts:
                        segment = raw[start : start + size + length - 1]
                        digest = xxhash.xxh3_128_digest(segment)
                        if digest in seen:
                            rows.append((0, doc_id, start, size, None))
                        else:
                            seen.add(digest)
                            rows.append((int.from_bytes(digest[:8], "little", signed=True) if key is None else key, doc_id, start, size, segment))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "start", "n", "segment"])

    return texts.mapInPandas(run, PIECES)


def repeated_runs(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, n): runs of starts whose strings start earlier as well."""

    def judge(keys: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, raw: list[bytes]) -> list[pd.DataFrame]:
        out = []
        order = np.lexsort((at, doc))
        # segments of repeated rows come twice
        order = order[(np.diff(doc[order], prepend=doc[order[0]] - 1) != 0) | (np.diff(at[order], prepend=-1) != 0)]
        seen: set[bytes] = set()
        whole = []
        for k in order.tolist():
            if raw[k] in seen:
                whole.append(k)
            else:
                seen.add(raw[k])
        if whole:
            out.append(pd.DataFrame({"doc_id": doc[whole], "start": at[whole], "n": n[whole]}))
        left = np.setdiff1d(order, whole)
        _, inverse, counts = np.unique(keys[left], return_inverse=True, return_counts=True)
        left = left[counts[inverse] > 1]  # within one cell no two strings are equal
        if len(left):
            sizes = n[left]
            flags = repeats([raw[k] for k in left.tolist()], sizes.tolist(), doc[left], at[left], length)
            owner = np.repeat(np.arange(len(left)), sizes)
            where = at[left][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            on = np.flatnonzero(flags)
            if len(on):
                breaks = np.concatenate(([True], (np.diff(on) != 1) | (np.diff(owner[on]) != 0)))
                heads = on[breaks]
                out.append(pd.DataFrame({"doc_id": doc[left][owner[heads]], "start": where[heads], "n": np.diff(np.append(np.flatnonzero(breaks), len(on)))}))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            yield from judge(rows["key"].to_numpy(), rows["doc_id"].to_numpy(), rows["start"].to_numpy(), rows["n"].to_numpy(np.int64), rows["segment"].tolist())

        for batch in batches:
            held.append(batch)
            size += sum(map(len, batch["segment"]))
            if size >= SORT_BYTES:
                rows = pd.concat(held, ignore_index=True)
                last = rows["key"].iloc[-1]
                cut = int((rows["key"] != last).sum())  # rows are sorted by key
                if cut:
                    yield from flush(rows.iloc[:cut])
                    held = [rows.iloc[cut:]]
                    size = sum(map(len, held[0]["segment"]))
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    dealt = segments.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "doc_id long, start long, n long")


def removed_ranges(starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges (from, to) that runs of removed starts cover."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], starts[order] + sizes[order] - 1 + length
    reach = np.maximum.accumulate(high)
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    return low[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document (keep_text: also the bytes kept)."""
    spark = docs.sparkSession
    prepare(spark)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.col("doc_id").isNotNull())
    cells = materialise(anchor_cells(picked, length), "anchor-cells")
    classes = cells.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") > 1)
    each = cells.select("doc_id", F.explode(F.arrays_zip("names", "cells")).alias("c")).select("doc_id", F.col("c.names").alias("name"), F.col("c.cells").alias("cell"))
    open_cells = each.join(classes, "name").select("doc_id", F.struct("cell", "name", (F.col("n_cells") > CROWDED).alias("crowded")).alias("c"))
    by_doc = open_cells.groupBy("doc_id").agg(F.collect_set("c").alias("cells"))
    found = materialise(pieces(picked.join(by_doc, "doc_id").sortWithinPartitions("doc_id"), length), "segments")
    runs = found.where(F.col("segment").isNull()).select("doc_id", "start", F.col("n").cast("long").alias("n"))
    runs = runs.unionByName(repeated_runs(found.where(F.col("segment").isNotNull()), length))
    spans = runs.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"].tolist(), batch["text"], batch["runs"]):
                raw = text.encode()
                kept, removed, n = raw, 0, 0
                if found is not None and len(found):
                    low, high = removed_ranges(np.array([r["start"] for r in found]), np.array([r["n"] for r in found]), length)
                    low, high = low[high <= len(raw)], high[high <= len(raw)]
                    cuts = np.concatenate(([0], np.stack((low, high), axis=1).reshape(-1), [len(raw)])).tolist()
                    kept = b"".join([raw[i:j] for i, j in zip(cuts[::2], cuts[1::2])])
                    removed, n = int((high - low).sum()), len(low)
                rows.append((doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return picked.join(spans, "doc_id", "left").mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
