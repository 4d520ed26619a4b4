"""Vector and ranking arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil.config import RRF_K


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths and zero norms."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def reciprocal_rank(rank: Column) -> Column:
    """A list's part of a fused score; a missing rank gives none."""
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))


def discounted_gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def back_off(attempts: Column) -> Column:
    """Seconds before the next delivery."""
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(300.0)).cast("int")
