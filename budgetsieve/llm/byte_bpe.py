"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's adjacent pairs wait in one bucket per merge rank; a bucket holds the linked-list
positions of its pairs. Three levels of 64-bit words mark the buckets that aren't empty, so that
the next rank is found by three find-first-set steps whatever the pre-token's length. Entries
aren't removed when a neighbour merges: an entry whose position has died or whose pair has changed
is stale and skipped when it surfaces. The cost is near linear in the bytes, so that a pre-token of
a million bytes is no problem.

Contract of :func:`encode_documents`: null texts count as empty, empty texts give no ids; ties
between equal ranks go to the leftmost pair; repeated rows give equal results; an empty table
gives an empty one; further input columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import chunked, own_cache, prepare, text_or_empty

#: Chunks whose ids a Python worker remembers, and their characters; beyond them the memory starts anew.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 16_000_000
#: Bytes of text whose unseen pre-tokens wait in one queue together.
BATCH_BYTES = 4_000_000

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"

#: Entries of a bucket from which they are merged by arrays.
MANY = 24

#: Bits for the right-hand id in a pair's key.
SHIFT = 20


class RankQueue:
    """Buckets of positions under integer ranks, with three levels of 64-bit words over them."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, positions: list[int]) -> None:
        """Puts positions under a rank whose bucket is empty."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that has a bucket and its positions from left to right, or None."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) | ((m & -m).bit_length() - 1)
        w = self.low[b]
        rank = (b << 6) | ((w & -w).bit_length() - 1)
        self.low[b] = w & (w - 1)
        if not self.low[b]:
            self.mid[a] = m & (m - 1)
            if not self.mid[a]:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Encodes pre-tokens by a table of ranks, many at a time in one queue.

    Pre-tokens of one call share the queue but never a pair. Within each of them merges come in
    order of rank, then from left to right: a merge that makes a pair of lower rank than its own
    puts the rest of its bucket back, so that the lower rank goes first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.merged = {(x << SHIFT) | y: rank for token, rank in ranks.items() for i in range(1, len(token)) if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None}
        self.keys, self.values = np.array(sorted(self.merged.items()), np.int64).reshape(-1, 2).T.copy()
        self.two = np.array([[self.merged.get((x << SHIFT) | y, -1) for y in self.single.tolist()] for x in self.single.tolist()], np.int64)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, packed as little-endian unsigned 32-bit integers."""
        ranks = self.ranks
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            whole = ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif piece:
                rest.append(k)
        if rest:
            starts = np.cumsum([0, *[len(pieces[k]) for k in rest]])
            ids = self._merge(np.frombuffer(b"".join([pieces[k] for k in rest]), np.uint8), starts)
            alive = ids >= 0
            at = np.concatenate(([0], np.cumsum(alive)))[starts].tolist()
            packed = ids[alive].astype("<u4").tobytes()
            for k, i, j in zip(rest, at, at[1:]):
                out[k] = packed[4 * i : 4 * j]
        return out

    def _merge(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte the id of the part that starts there, or -1 inside a part."""
        n, queue = len(data), self.queue
        first = np.append(self.two[data[:-1], data[1:]], -1)
        first[starts[1:] - 1] = -1
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[starts[1:] - 1] = -1
        before[starts[:-1]] = -1
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[waiting], prepend=-1))
        positions = waiting.tolist()
        for rank, i, j in zip(first[waiting[cuts]].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(positions)]):
            queue.add(rank, positions[i:j])
        ids = self.single[data]
        state = first, following, before, ids
        piece = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        while (entry := queue.pop()) is not None:
            rank, bucket = entry
            if len(bucket) >= MANY:
                at = np.array(bucket)
                at = at[first[at] == rank]
                alone = np.diff(piece[at], prepend=-1) != 0
                lower = self._merge_many(rank, at[alone], state)
                bucket = at[~alone].tolist()
                if lower and bucket:
                    queue.add(rank, bucket)
                    continue
            self._merge_one_by_one(rank, bucket, [memoryview(x) for x in state])
        return ids

    def _push(self, rank: int, position: int) -> None:
        bucket = self.queue.buckets.get(rank)
        if bucket is None:
            self.queue.add(rank, [position])
        else:
            bucket.append(position)

    def _merge_many(self, rank: int, i: np.ndarray, state: tuple) -> bool:
        """Merges one pair in each of many pre-tokens; whether a pair of lower rank came up."""
        pair, right, left, ids = state
        j = right[i]
        k = right[j]
        ids[i], ids[j], pair[j], right[i], pair[i] = rank, -1, -1, k, -1
        h = left[i]
        goes_on, h_at = k >= 0, h >= 0
        left[k[goes_on]] = i[goes_on]
        at = np.concatenate((i[goes_on], h[h_at]))
        keys = np.concatenate(((rank << SHIFT) | ids[k[goes_on]], (ids[h[h_at]] << SHIFT) | rank))
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = np.where(self.keys[found] == keys, self.values[found], -1)
        pair[at] = new
        there = new >= 0
        for r, position in zip(new[there].tolist(), at[there].tolist()):
            self._push(r, position)
        return bool((new[there] < rank).any())

    def _merge_one_by_one(self, rank: int, bucket: list[int], state: list[memoryview]) -> None:
        pair, right, left, ids = state
        merged = self.merged
        for at, i in enumerate(bucket):
            if pair[i] != rank:
                continue  # stale: the part has died or its pair has changed
            j = right[i]
            k = right[j]
            ids[i], ids[j], pair[j], right[i] = rank, -1, -1, k
            after = above = -1
            if k >= 0:
                left[k] = i
                after = merged.get((rank << SHIFT) | ids[k], -1)
                if after >= 0:
                    self._push(after, i)
            pair[i] = after
            h = left[i]
            if h >= 0:
                pair[h] = above = merged.get((ids[h] << SHIFT) | rank, -1)
                if above >= 0:
                    self._push(above, h)
            if (0 <= after < rank or 0 <= above < rank) and at + 1 < len(bucket):
                self.queue.add(rank, bucket[at + 1 :])
                return


class Codec:
    """Whole texts to ids as little-endian unsigned 32-bit integers, and back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE_ENTRIES):
        self.encoder = Encoder(ranks)
        self.find = regex.compile(pattern).findall
        self.cache, self.known, self.held = cache, {}, 0
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def _learn(self, chunks: set[str]) -> None:
        """Remembers the ids of chunks that follow a space; None where one isn't safe to cut out."""
        cut = {c: self.find(" " + c) for c in chunks if c and not c[0].isspace() and not c[-1].isspace()}
        pieces = list({p for found in cut.values() for p in found})
        ids = dict(zip(pieces, self.encoder.encode([p.encode() for p in pieces])))
        for c in chunks:
            self.known[c] = b"".join([ids[p] for p in cut[c]]) if c in cut else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        ids = iter(self.encoder.encode([p.encode() for pieces in found for p in pieces]))
        return [b"".join([next(ids) for _ in pieces]) for pieces in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """A space between two characters that aren't white space always starts a match: texts are
        cut there, and each distinct chunk is encoded once. Texts with other spaces go in whole."""
        cut = [t.split(" ") for t in texts]
        known = self.known
        words = set().union(*cut)
        unseen = words - known.keys()
        if len(known) + len(unseen) > self.cache or self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
            unseen = words
        if unseen:
            self._learn(unseen)
            self.held += sum(map(len, unseen))
        starts = list({chunks[0] for chunks in cut})
        heads = dict(zip(starts, self._whole(starts)))
        get = known.__getitem__
        out = []
        for text, chunks in zip(texts, cut):
            head = chunks[0]
            if len(chunks) == 1:
                out.append(heads[head])
                continue
            parts = list(map(get, chunks))
            parts[0] = heads[head] if head and not head[-1].isspace() else None
            out.append(self._whole([text])[0] if None in parts else b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with keep_ids also the ids (binary).

    Each document is encoded and decoded on its own: no shuffle, one pass, batches of bounded rows.
    The vocabulary is a file of ranks that every worker can open (default: the public multilingual one).
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        c = codec(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        own_cache("byte_bpe", c.known)
        for ids_of, texts in chunked(batches, BATCH_BYTES):
            encoded = c.encode(texts)
            decoded = [c.decode(ids) for ids in encoded]
            out = pd.DataFrame(
                {
                    "doc_id": ids_of,
                    "n_tokens": [len(ids) // 4 for ids in encoded],
                    "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in encoded],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                    "n_bytes": [len(d) for d in decoded],
                }
            )
            if keep_ids:
                out["ids"] = encoded
            yield out

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInPandas(run, RESULT + (", ids binary" if keep_ids else ""))
