"""Normalisations of a bridge count, and the charge composition behind them."""

from pyspark.sql import Column, functions as F

from titrant import constants as K
from titrant.functions.charge import count_letters


def or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def composition(df, seq: str = "seq", histidine: bool = False):
    c = F.col(seq)
    positive = K.TITRATING_POSITIVE if histidine else K.SIMPLE_POSITIVE
    return (
        df.withColumn("n_cationic", count_letters(c, positive).cast("bigint"))
        .withColumn("n_anionic", count_letters(c, K.SIMPLE_NEGATIVE).cast("bigint"))
        .withColumn("n_residues", F.length(c).cast("bigint"))
        .withColumn("n_charged", F.col("n_cationic") + F.col("n_anionic"))
        .withColumn("n_opportunities", F.col("n_cationic") * F.col("n_anionic"))
    )


def normalised(df, area: str | None = None):
    """Adds the ratios to a table with n_bridges, n_charged, n_opportunities and n_engaged."""
    out = (
        df.withColumn("per_charged_residue", or_zero(F.col("n_bridges"), F.col("n_charged")))
        .withColumn("per_opportunity", or_zero(F.col("n_bridges"), F.col("n_opportunities")))
        .withColumn("fraction_engaged", or_zero(F.col("n_engaged"), F.col("n_charged")))
    )
    if area:
        # A zero or negative area means the region was never computed: refused, not divided by.
        ok = F.col(area) > 0
        out = out.withColumn(
            "per_1000_area", F.when(ok, F.lit(1000.0) * F.col("n_bridges") / F.col(area))
        ).withColumn("area_error", F.when(~ok | F.col(area).isNull(), F.lit("area must be positive")))
    return out


def expected_by_chance(n_cationic: Column, n_anionic: Column, observed_density: Column) -> Column:
    return n_cationic * n_anionic * observed_density


def composition_status(left: Column, right: Column, tolerance: float = 0.10) -> Column:
    """ok, no_charge or unmatched: whether two raw counts may be compared at all."""
    gap = F.try_divide(F.abs(left - right).cast("double"), F.greatest(left, right))
    return (
        F.when((left == 0) | (right == 0), "no_charge")
        .when(gap > tolerance, "unmatched")
        .otherwise("ok")
    )
