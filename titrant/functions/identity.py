"""Position-wise agreement of two texts of equal length."""

from pyspark.sql import Column, functions as F


def matches(a: Column, b: Column) -> Column:
    """Number of equal positions over the shorter length."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda total, hit: total + hit,
    )


def identity(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 when lengths differ or both are empty."""
    comparable = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(comparable, matches(a, b) / F.length(a)).otherwise(0.0)


def mutations(seq: Column, native: Column) -> Column:
    """Positions that differ from the native; null when lengths differ."""
    return F.when(F.length(seq) == F.length(native), F.length(seq) - matches(seq, native))
