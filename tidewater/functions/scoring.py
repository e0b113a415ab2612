"""Scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def bm25_idf(n: Column, df: Column, kind: str = "plus") -> Column:
    """`plus`: ln(1 + x), never negative; `plain`: ln(x)."""
    if kind not in ("plus", "plain"):
        raise ValueError(f"unknown idf: {kind}")
    x = (n - df + 0.5) / (df + 0.5)
    return F.log1p(x) if kind == "plus" else F.log(x)


def bm25_term(tf: Column, length: Column, mean_length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (k + rank)


def decay(age: Column, scale: float) -> Column:
    """exp(-age/scale), 0 without an age. The scale is an e-folding time."""
    return F.coalesce(F.exp(-age / max(scale, 1.0)), F.lit(0.0))


def maturity(age: Column, scale: float) -> Column:
    return F.coalesce(1 - F.exp(-age / max(scale, 1.0)), F.lit(0.0))


def min_max(c: Column, w: WindowSpec, flat: Column | None = None) -> Column:
    """(c - min) / (max - min) over w; where all are equal, `flat` (1 by default)."""
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (c - lo) / (hi - lo)).when(c.isNotNull(), F.lit(1.0) if flat is None else flat)
