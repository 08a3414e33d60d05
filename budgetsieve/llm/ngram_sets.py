"""Word n-gram sets of whole texts and their PartEnum signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Words to 64-bit hashes, remembered up to a bound; long words aren't, so that the bound holds in bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 150_000:
                self.clear()
            self[word] = h
        return h


word_hashes = _WordHashes()


def ngrams(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of words.

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. A text of
    fewer words is one n-gram; one without words has none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(w))
    h = w[: len(w) - n + 1] * _M1
    for i in range(1, n):
        h = (mix(h) + w[i : len(w) - n + 1 + i]) * _M1
    return np.unique(mix(h + np.uint64(n)))


#: Second-level parts of each first-level part, and how many of them a signature leaves out.
SECOND, LEFT_OUT = 3, 1
#: Elements of a subset in the mean from which it hardly agrees by chance.
FULL = 10


class PartEnum:
    """Signatures for sets of 64-bit hashes such that sets of Jaccard similarity >= threshold share one.

    Sizes fall into bands: band b holds sizes from low_b to floor(low_b / threshold). Two similar sets
    lie in one band or in neighbouring ones, so that a set signs with the parameters of its own band
    and of the next. Within band b similar sets differ in at most k_b = floor(2 high_b (1 - t) / (1 + t))
    elements. The domain is cut into first-level parts, each of these into ``SECOND`` second-level parts,
    and every subset that leaves ``LEFT_OUT`` of these out gives a signature: the set's content there.
    At most k_b // (LEFT_OUT + 1) first-level parts hold more than LEFT_OUT differences. With ``spare``
    parts more than that, so many are good ones, and in each of these one subset agrees.

    A subset of few elements says little, and sets that have it meet by chance. If a set has subsets of at
    most c elements in fewer first-level parts than ``spare``, it has a good part without them, whatever it
    is compared with, and may leave them out. Each set does so with its largest such c. Of two similar sets
    take the one with the larger c: its good part's common subset has more elements than either c.
    """

    def __init__(self, threshold: float):
        self.t = threshold
        self.highs: list[int] = []
        low = 1
        while low < 1 << 40:
            self.highs.append(max(low, int(low / threshold + 1e-9)))
            low = self.highs[-1] + 1
        self._highs = np.array(self.highs)
        self._named: dict[tuple[np.uint64, int], np.ndarray] = {}
        self.kept = np.array([[i not in c for i in range(SECOND)] for c in combinations(range(SECOND), LEFT_OUT)], np.uint64).T

    def band(self, size: int) -> int:
        return int(np.searchsorted(self._highs, size))

    def differences(self, band: int) -> int:
        """How many elements similar sets of a band differ in at most."""
        return int(2 * self.highs[band] * (1 - self.t) / (1 + self.t) + 1e-9)

    def shape(self, band: int) -> tuple[int, int]:
        """First-level parts of a band and how many of them are spare: more where subsets have few elements."""
        least = self.differences(band) // (LEFT_OUT + 1)
        full = self.highs[band] * (SECOND - LEFT_OUT) >= FULL * SECOND * least
        spare = 1 if full else 1 + least // 5
        return least + spare, spare

    @staticmethod
    def running(items: np.ndarray) -> np.ndarray:
        """Running sums of the elements' hashes, from 0 on."""
        total = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items + _M1), out=total[1:])
        return total

    @staticmethod
    def contents(items: np.ndarray, total: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each part of the domain the sum of its elements' hashes and their number."""
        # parts are ranges of the hash domain, so that sorted items are sorted by part
        ends = np.searchsorted(((items >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        return np.diff(total[ends]), np.diff(ends)

    def _names(self, kind: np.uint64, band: int, n: int) -> np.ndarray:
        if (kind, band) not in self._named:
            self._named[kind, band] = mix((np.arange(n, dtype=np.uint64) << np.uint64(16)) + np.uint64(band) + kind)
        return self._named[kind, band]

    def _enumerate(self, items: np.ndarray, total: np.ndarray, band: int) -> np.ndarray:
        if not self.differences(band):  # similar sets are equal
            return mix(total[-1:] ^ self._names(_M1, band, 1))
        first, spare = self.shape(band)
        content, filled = self.contents(items, total, first * SECOND)
        signature = content.reshape(first, SECOND) @ self.kept
        signature = mix(signature.ravel() ^ self._names(_M1, band, signature.size))
        size = filled.reshape(first, SECOND) @ self.kept.astype(np.int64)
        enough = np.partition(size.min(axis=1), spare - 1)[spare - 1]
        return signature[size.ravel() >= enough]

    def sign(self, items: np.ndarray) -> np.ndarray:
        """The signatures of a set; the empty set has none."""
        if not len(items):
            return np.zeros(0, np.uint64)
        own, total = self.band(len(items)), self.running(items)
        return np.concatenate([self._enumerate(items, total, band) for band in (own, own + 1)])

    def listing(self, items: np.ndarray, band: int, spread: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
        """One level only: each part's signature, its elements, and how many listed parts must meet.

        With p = spread (k + 1) parts similar sets have at least p - k in common. If all sets list their parts
        in one order, the first k + 1 listed of two similar sets must meet, as p - k can't all stand behind.
        """
        k = self.differences(band)
        parts = spread * (k + 1) if k else 1
        content, filled = self.contents(items, self.running(items), parts)
        return mix(content ^ self._names(_M2, band, parts)), filled, k + 1


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)
