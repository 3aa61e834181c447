"""Running-sum hashes of code points, vectorised over whole batches of texts."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def points_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Sums:
    """Hash of any span of an array of code points in constant time; equal spans have equal hashes wherever they stand."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.up, down = powers(1 << max(20, (n + 1).bit_length()))
        c = mixed((points.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * down[:n], dtype=np.uint64)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        return mixed((self.total[end] - self.total[start]) * self.up[start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
