"""Hashes of words and of windows of words, for operators that run numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > 200_000:
        _known.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for at, word in enumerate(words):
        value = _known.get(word)
        if value is None:
            value = _known[word] = xxhash.xxh3_64_intdigest(word)
        out[at] = value
    return out


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One hash for each window of ``size`` words, in order; for fewer words one hash of them all; none for none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes, take = word_hashes(words), min(size, len(words))
    windows = len(hashes) - take + 1
    value = np.full(windows, take, dtype=np.uint64)
    for k in range(take):
        value = mixed(value + hashes[k : windows + k])
    return value
