"""Hashes of runs of consecutive words, for all places of many texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from criteria_engine.llm.tables import codes, words

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and offsets of the texts."""
    flat, offsets = words(texts)
    hashed = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False).astype(object))
    return hashed.astype(np.uint64)[codes(flat)], offsets


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Runs:
    """Polynomial hashes modulo 2^64 of any run of the words."""

    def __init__(self, hashed: np.ndarray, base: np.uint64 = BASES[0]):
        n = len(hashed)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]).astype(np.uint64))
        inverse = np.uint64(pow(int(base), -1, 2**64))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]).astype(np.uint64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed * powers[:n])]).astype(np.uint64)

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[places + length] - self.sums[places]) * self.back[places])
