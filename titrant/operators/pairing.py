"""Comparison of every row with its own lineage at the reference dose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} needs column(s) {missing}; present: {sorted(df.columns)}")


def duplicated_references(df: DataFrame, keys: Sequence[str], dose: str, reference: float = 0.0) -> DataFrame:
    """Lineages with more than one row at the reference dose; a delta would depend on row order."""
    at = df.where(F.col(dose) == reference)
    return at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reference")).where("n_reference > 1")


def _with_reference(df, keys, metrics, dose, reference, policy):
    """The rows with their lineage's reference. The refusal is a filter above the join, which no
    selection of columns can prune away."""
    at = df.where(F.col(dose) == reference)
    one = at.groupBy(*keys).agg(
        *[F.min(m).alias(f"_ref_{m}") for m in metrics], F.count(F.lit(1)).alias("_n_reference")
    )
    joined = df.join(one, list(keys), "left")
    if policy == "raise":
        bad = F.raise_error(F.lit("more than one reference row in a lineage")).cast("boolean")
        joined = joined.where(F.when(F.col("_n_reference") > 1, bad).otherwise(F.lit(True)))
    return joined.drop("_n_reference")


def paired_deltas(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], dose: str = "beta", reference: float = 0.0,
    on_duplicate: str = "raise",
) -> DataFrame:
    """Keeps every row; delta is null where the lineage has no reference, never 0.

    The reference side is one row per lineage, so a lineage holding a large share of the rows is
    split by the adaptive skew join instead of landing in one task as a window would make it.
    """
    require_columns(df, [*keys, dose, *metrics], "paired_deltas")
    joined = _with_reference(df, keys, metrics, dose, reference, on_duplicate)
    seen = F.coalesce(*[F.col(f"_ref_{m}") for m in metrics]).isNotNull()
    return joined.select(
        *df.columns,
        *[(F.col(m) - F.col(f"_ref_{m}")).alias(f"delta_{m}") for m in metrics],
        seen.alias("has_reference"),
    )


def paired_change(
    df: DataFrame, keys: Sequence[str], metric: str, dose: str = "beta", reference: float = 0.0
) -> DataFrame:
    """Drops reference rows and rows without a usable pair."""
    one = df.where((F.col(dose) == reference) & F.col(metric).isNotNull()).select(
        *keys, F.col(metric).alias("reference")
    )
    other = df.where((F.col(dose) != reference) & F.col(metric).isNotNull())
    return other.join(one, list(keys)).select(
        *keys, dose, metric, "reference", (F.col(metric) - F.col("reference")).alias("delta")
    )


def lineage_doses(df: DataFrame, keys: Sequence[str], dose: str, wanted: Sequence[float] | None) -> DataFrame:
    """(keys, rows, complete): whether a lineage has every wanted dose (default: every dose seen)."""
    if wanted is None:
        n_wanted = df.agg(F.count_distinct(dose)).first()[0]
        hit = F.col(dose)
    else:
        n_wanted = len(set(wanted))
        hit = F.when(F.col(dose).isin(*wanted), F.col(dose))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_distinct(hit) == n_wanted).alias("complete")
    )


def balanced_panel(df: DataFrame, keys: Sequence[str], dose: str = "beta", wanted: Sequence[float] | None = None) -> DataFrame:
    """Only lineages that came back at every dose; no wanted dose, no rows."""
    if wanted is not None and not wanted:
        return df.limit(0)
    complete = lineage_doses(df, keys, dose, wanted).where("complete")
    return df.join(complete, list(keys), "left_semi")


def pairing_report(df: DataFrame, keys: Sequence[str], dose: str = "beta", wanted: Sequence[float] | None = None) -> DataFrame:
    """One overall row (null dose) and one row per dose, from two small aggregates."""
    overall = lineage_doses(df, keys, dose, wanted).agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_lineages"),
        F.count_if("complete").alias("n_lineages_complete"),
        F.coalesce(F.sum(F.when(F.col("complete"), F.col("rows"))), F.lit(0)).alias("n_rows_balanced"),
    )
    per_dose = df.groupBy(dose).agg(F.count(F.lit(1)).alias("n_rows"))
    return overall.withColumn(dose, F.lit(None).cast("double")).unionByName(per_dose, allowMissingColumns=True)


def completeness(df: DataFrame, expected: int, dose: str = "beta", gap: float = 0.15) -> DataFrame:
    """Return rate per dose; a dose more than `gap` below the best is depleted."""
    from pyspark.sql import Window as W

    rates = df.groupBy(dose).agg(F.count(F.lit(1)).alias("n_returned")).withColumn(
        "rate", F.col("n_returned") / F.lit(expected)
    )
    best = F.max("rate").over(W.partitionBy(F.lit(1)))  # one row per dose
    return rates.withColumn("depleted", best - F.col("rate") > gap)


def retained(df: DataFrame, keys: Sequence[str], confidence: str, limit: float, dose: str = "beta", reference: float = 0.0) -> DataFrame:
    """Rows that lost at most `limit` of their own reference confidence; no reference, kept."""
    one = df.where((F.col(dose) == reference) & F.col(confidence).isNotNull()).select(
        *keys, F.col(confidence).alias("_reference")
    )
    drop = F.col("_reference") - F.col(confidence)
    return df.join(one, list(keys), "left").where(drop.isNull() | (drop <= limit)).select(*df.columns)


def mixed_backends(df: DataFrame, keys: Sequence[str], device: str) -> DataFrame:
    """Lineages that ran on more than one device, a missing one counted as 'unrecorded'."""
    return df.groupBy(*keys).agg(
        F.count_distinct(F.coalesce(device, F.lit("unrecorded"))).alias("n_devices"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce(device, F.lit("unrecorded")))), ",").alias("devices"),
    ).where("n_devices > 1")


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, rows) in one aggregate over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])
    return counts.select("_rows", F.explode(cells).alias("c")).select(
        "c.column", "c.filled", F.col("_rows").alias("rows")
    )


def coverage(df: DataFrame, complex_key: str, dose: str) -> DataFrame:
    """How many complexes have a given number of doses."""
    per = df.groupBy(complex_key).agg(F.count_distinct(dose).alias("n_doses"))
    return per.groupBy("n_doses").agg(F.count(F.lit(1)).alias("n_complexes"))


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of ids in both, only left, only right; ids are compared as text."""
    l = left.select(F.col(key).cast("string").alias("id")).distinct().withColumn("l", F.lit(1))
    r = right.select(F.col(key).cast("string").alias("id")).distinct().withColumn("r", F.lit(1))
    both = l.join(r, "id", "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_common"),
        F.count_if(F.col("r").isNull()).alias("n_only_left"),
        F.count_if(F.col("l").isNull()).alias("n_only_right"),
    )


def control_status(df: DataFrame, column: str, policy: str = "refuse") -> DataFrame:
    """What a partly filled control column means under a policy."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_filled"))
    part = (F.col("n_filled") > 0) & (F.col("n_filled") < F.col("n_rows"))
    return n.withColumn(
        "status",
        F.when(F.col("n_filled") == 0, "no_control").when(~part, "complete").otherwise(F.lit({
            "refuse": "refused", "drop": "drop_rows", "no-control": "no_control"}[policy])),
    )


def apply_control_policy(df: DataFrame, column: str, policy: str = "refuse") -> DataFrame:
    if policy == "drop":
        return df.where(F.col(column).isNotNull())
    if policy == "no-control":
        return df
    state = control_status(df, column).first()
    if state["status"] == "refused":
        raise ValueError(
            f"{state['n_rows'] - state['n_filled']} of {state['n_rows']} rows have no {column}; "
            "choose policy 'drop' or 'no-control'"
        )
    return df
