"""Which charge definition best reproduces a reported value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from titrant.functions.charge import CANDIDATES
from titrant.operators.ordering import quantiles
from titrant.session import keep


def candidate_errors(
    df: DataFrame, seq: str, reported: str, candidates: dict[str, Callable[[Column], Column]] = CANDIDATES
) -> DataFrame:
    """One row per (row, definition) with the computed charge and its error."""
    cells = [
        F.struct(F.lit(label).alias("definition"), build(F.col(seq)).alias("computed"))
        for label, build in candidates.items()
    ]
    long = df.select(F.col(reported).alias("_reported"), F.explode(F.array(*cells)).alias("_c"))
    return long.select("_c.*", (F.col("_c.computed") - F.col("_reported")).alias("error"))


def reconcile(df: DataFrame, seq: str, reported: str, tolerance: float = 0.51, candidates=CANDIDATES) -> DataFrame:
    # Read by the averages and by the median: a few numbers per row instead of its text.
    errors = keep(candidate_errors(df, seq, reported, candidates)).withColumn("ae", F.abs("error"))
    stats = errors.groupBy("definition").agg(
        F.avg("ae").alias("mean_absolute_error"),
        F.max("ae").alias("max_absolute_error"),
        F.avg("error").alias("mean_signed_error"),
        F.avg(F.when(F.col("ae") <= tolerance, 1.0).otherwise(0.0)).alias("fraction_within_tolerance"),
        F.count(F.lit(1)).alias("n_designs"),
    )
    middle = quantiles(errors, ["definition"], "ae", {"median_absolute_error": 0.5})
    return stats.join(middle, "definition").orderBy("mean_absolute_error", "definition")
