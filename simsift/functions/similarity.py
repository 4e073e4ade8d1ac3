"""Distances between arrays, as column expressions; any Column, Column -> Column function can stand in for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Share of positions that differ."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return differ / F.greatest(F.size(a), F.size(b))


def common_prefix(a: Column, b: Column, k: int) -> Column:
    """Length of the longest common prefix, k at most."""
    same = lambda n, i: F.when((n == i - 1) & F.element_at(a, i).eqNullSafe(F.element_at(b, i)), i).otherwise(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), same)


def equal_share(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures: an estimate of the Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)
