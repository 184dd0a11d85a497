"""Word shingles of texts as sorted 64-bit hashes, computed with array operations on the UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, after A-Z became a-z. A text's set holds the
hashes of all its ``size``-word windows; a text of fewer words gives one hash of all of them, a text without words
(or null) none.
"""

from __future__ import annotations

import numpy as np

from lorekeep.llm.worker import kept

U = np.uint64
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
LETTER = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


KEPT_BITS = 20  # powers up to this many are remembered by a worker, longer rows of them are made anew


def powers(base: int, bits: int) -> np.ndarray:
    """1, base, base ** 2, ... (2 ** bits of them, modulo 2 ** 64)."""
    if bits <= KEPT_BITS:
        known = kept("powers")
        if base not in known:
            known[base] = powers_up_to(base, KEPT_BITS)
        return known[base][: 1 << bits]
    return powers_up_to(base, bits)


def powers_up_to(base: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U), np.full((1 << bits) - 1, base, U)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(GAP[b], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    bits = max(12, int(len(b)).bit_length())
    sums = np.concatenate([np.zeros(1, U), np.cumsum(LETTER[b] * powers(BASE, bits)[: len(b)], dtype=U)])
    return mixed((sums[end] - sums[start]) * powers(BACK, bits)[start] + (end - start).astype(U))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    if not text:
        return np.zeros(0, U)
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, U)
    width = min(size, n)
    total = np.full(n - width + 1, width, U)
    for k in range(width):
        total += words[k : n - width + 1 + k] * PLACE[k % len(PLACE)] + (total >> U(29))
    return np.unique(mixed(total))
