"""Hashed word n-grams: the features of both linear classifiers.

A text is lower-cased and cut into runs of word characters and runs of other visible characters. Each run hashes
to 64 bits; unigrams and bigrams fall into 2**BITS slots. A bigram of a run with itself has one slot for all runs,
so that stuttering reads alike in any vocabulary.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

BITS = 20
MASK = np.uint64((1 << BITS) - 1)
_STUTTER = np.uint64(0x5BD1E995)
_RUNS = re.compile(r"\w+|[^\w\s]+")
_CACHE_WORDS = 300_000


class Runs:
    """Run hashes of texts, by way of a bounded cache from white-space words to their runs' hashes."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        runs = (low,) if low.isalnum() else _RUNS.findall(low)
        got = tuple([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in runs])
        if len(word) <= 40:
            if len(self.of) >= _CACHE_WORDS:
                self.of.clear()
            self.of[word] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        of, word = self.of, self._word
        parts = [hit if (hit := of.get(w)) is not None else word(w) for w in text.split()]
        return np.fromiter(chain.from_iterable(parts), dtype=np.uint64)


def slots(runs: np.ndarray) -> np.ndarray:
    """Slot numbers of the unigrams and bigrams, with repeats."""
    if not len(runs):
        return np.zeros(0, dtype=np.int64)
    a, b = runs[:-1], runs[1:]
    two = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    two ^= two >> np.uint64(29)
    two[a == b] = _STUTTER
    return (np.concatenate([runs, two]) & MASK).astype(np.int64)
