"""How often values land in a target window, and how far two definitions disagree about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from titrant.operators.ordering import medians, quantiles
from titrant.operators.resample import bootstrap_interval


def window_summary(
    df: DataFrame, groups: Sequence[str], value: str, unit: str, low: float, high: float,
    target: Column | float | None = None, *, n_resamples: int = 10_000, seed: int = 0,
) -> DataFrame:
    """Inclusive membership, errors against the target (default: the window's centre) and an interval."""
    if low >= high:
        raise ValueError(f"low must be below high, got {low}, {high}")
    aim = F.lit((low + high) / 2) if target is None else (target if isinstance(target, Column) else F.lit(target))
    marked = df.where(F.col(value).isNotNull()).select(
        *groups, unit, F.col(value).between(low, high).cast("double").alias("inside"),
        F.abs(F.col(value) - aim).alias("ae"))
    stats = marked.groupBy(*groups).agg(
        F.sum("inside").cast("bigint").alias("n_inside"), F.avg("inside").alias("fraction_inside"),
        F.avg("ae").alias("mean_absolute_error"))
    middle = quantiles(marked, groups, "ae", {"median_absolute_error": 0.5})
    interval = bootstrap_interval(marked, groups, "inside", unit, n_resamples=n_resamples, seed=seed).select(
        *groups, "n", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    return stats.join(middle, list(groups)).join(interval, list(groups)).withColumn(
        "mae_exceeds_window", F.col("mean_absolute_error") > high - low)


def disagreement(df: DataFrame, groups: Sequence[str], a: str, b: str, low: float, high: float) -> DataFrame:
    ina, inb = F.col(a).between(low, high), F.col(b).between(low, high)
    offset = F.col(a) - F.col(b)
    stats = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ina).alias("n_inside_a"), F.count_if(inb).alias("n_inside_b"),
        F.count_if(ina != inb).alias("n_disagree"), F.count_if(ina & ~inb).alias("n_only_a"),
        F.count_if(inb & ~ina).alias("n_only_b"), F.avg(offset).alias("mean_offset"),
        F.max(F.abs(offset)).alias("max_absolute_offset"),
        (F.max(offset) - F.min(offset) < 1e-9).alias("offset_is_constant"))
    middle = medians(df.withColumn("offset", offset), groups, ["offset"]).select(*groups, F.col("median").alias("median_offset"))
    return stats.join(middle, list(groups))


def unequal_sizes(df: DataFrame, group: str) -> DataFrame:
    """Best-of-n comparisons favour the larger group: flag and sorted distinct sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        (F.count_distinct("n") > 1).alias("unequal"),
        F.array_join(F.array_sort(F.collect_set("n")), ",").alias("sizes"))
