"""Spark's xxhash64 over BIGINT columns, for numpy: cells hashed in the JVM are found again while peeling."""

from __future__ import annotations

import numpy as np

# Fixed values of the public XXH64 algorithm.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64_longs(*columns: np.ndarray | int) -> np.ndarray:
    """The value F.xxhash64 gives for BIGINT columns in this order (seed 42, chained)."""
    with np.errstate(over="ignore"):
        h: np.ndarray = np.uint64(42)  # type: ignore[assignment]
        for c in columns:
            x = np.uint64(c & 0xFFFFFFFFFFFFFFFF) if isinstance(c, int) else np.ascontiguousarray(c).view(np.uint64)
            g = h + _P5 + np.uint64(8)
            g = g ^ (_rotl(x * _P2, 31) * _P1)
            g = _rotl(g, 27) * _P1 + _P4
            g = (g ^ (g >> np.uint64(33))) * _P2
            g = (g ^ (g >> np.uint64(29))) * _P3
            h = g ^ (g >> np.uint64(32))
    return np.asarray(h).view(np.int64)
