"""Vectors as arrays, and the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIM = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hash_bucket(token: Column, dim: int = HASH_DIM) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
