"""Plain-language readings of test results, as lookups over their outcomes."""

from pyspark.sql import Column, DataFrame, functions as F


def direction(estimate: Column, resolved: Column, less: str = "less", more: str = "more") -> Column:
    """less/more, with a caveat when the interval includes zero."""
    return F.concat(
        F.when(estimate < 0, less).otherwise(more),
        F.when(resolved, "").otherwise(", but the interval includes zero"),
    )


def quality_reading(summary: DataFrame, primary: str = "all_returned") -> DataFrame:
    """One of four readings (or 'no control') from per-dose results with subset, estimate, excludes_zero."""
    fell = F.col("excludes_zero") & (F.col("estimate") < 0)
    return quality_of(summary.select("subset", fell.alias("fell")), primary)


def quality_of(fell: DataFrame, primary: str = "all_returned") -> DataFrame:
    """The same reading from (subset, fell), in any number of rows per subset."""
    whole, fell_ = F.col("subset") == primary, F.col("fell")
    seen = fell.agg(
        F.coalesce(F.bool_or(whole & fell_), F.lit(False)).alias("overall"),
        F.coalesce(F.bool_or(~whole & fell_), F.lit(False)).alias("folded"),
        F.coalesce(F.bool_or(~whole), F.lit(False)).alias("controlled"))
    text = (
        F.when(~F.col("controlled"), "no quality control was possible")
        .when(F.col("overall") & F.col("folded"), "degrades, also among rows that held up")
        .when(F.col("overall"), "degrades overall but not among rows that held up")
        .when(F.col("folded"), "degrades only among rows that held up: selection on a collider")
        .otherwise("no measurable degradation")
    )
    return seen.withColumn("reading", text)
