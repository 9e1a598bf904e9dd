"""Words and their hashes, for the operators that work on runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of a 64-bit polynomial hash and of the finishing mix (splitmix64's published values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than space, tab, newline, vertical tab, form feed and return.

    bytes.split() cuts at just these six and bytes.lower() changes A-Z only.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words, from the words' hashes; empty below k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= BASE
            out += h[j : j + n]
        return mix(out)
