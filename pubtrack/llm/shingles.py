"""Hashes of words and word windows of many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MASK = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest table asked for so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Words:
    """Word hashes of several texts end to end; text ``i`` has words ``first[i] : first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``k`` words (of any text end to end, so also across texts) by start, and the
        mask of the runs that lie inside one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out *= np.uint64(WORD_BASE)
            out += self.hashes[i:n + i]
        inside = np.ones(n, dtype=bool)
        for end in self.first[1:-1]:
            inside[max(0, end - k + 1):min(end, n)] = False
        return mixed(out), inside


def words_of(texts: list[bytes], lower: bool) -> Words:
    """Words (runs of bytes other than space and U+0009 to U+000D) of UTF-8 texts."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if lower:
        buffer = LOWERED[buffer]
    space = IS_SPACE[buffer]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    if not len(starts):
        return Words(np.empty(0, dtype=np.uint64), first)
    # Polynomial from the left: sum of byte * base ** place, then divided by base ** start (base is odd).
    power = powers(BYTE_BASE, len(buffer))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    back = powers(pow(BYTE_BASE, -1, 1 << 64), len(buffer))
    value = (sums[ends] - sums[starts]) * back[starts]
    return Words(mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), first)
