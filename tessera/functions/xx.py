"""Spark's xxhash64 of bigint columns, in numpy, for code that has to agree with the JVM side."""

from __future__ import annotations

import numpy as np

# The primes of XXH64 and Spark's seed.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xx_chain(*columns: np.ndarray | int) -> np.ndarray:
    """As xxhash64(columns...) of non-null bigints."""
    n = max((len(c) for c in columns if not isinstance(c, int)), default=1)
    h = np.full(n, SEED, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.full(n, c, np.int64).view(np.uint64) if isinstance(c, int) else np.ascontiguousarray(c, np.int64).view(np.uint64)
            h = h + P5 + np.uint64(8)
            h ^= _turn(x * P2, 31) * P1
            h = _turn(h, 27) * P1 + P4
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)
