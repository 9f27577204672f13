"""Length normalisations of an interface score. The two forms differ below 28 on purpose."""

from pyspark.sql import Column, functions as F


def _curve(length: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(1.24) * F.pow(length - 15.0, F.lit(1.0 / 3.0)) - 1.8)


def d0_scalar(length: Column) -> Column:
    """Exactly 1 up to 27 residues."""
    length = length.cast("double")
    return F.when(length > 27.0, _curve(F.greatest(length, F.lit(27.0)))).otherwise(1.0)


def d0_array(length: Column) -> Column:
    """Length floored at 26 first."""
    return _curve(F.greatest(F.lit(26.0), length.cast("double")))


def closeness(pae: Column, d0: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(pae / d0, 2))
