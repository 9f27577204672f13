"""Charge, counts and densities per region of a chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from titrant.functions import charge as Q
from titrant.operators.joins import measured
from titrant.params import ChargeParams

REGIONS = ("interface", "surface", "core")


def partition_charge(
    residues: DataFrame, keys: Sequence[str], p: ChargeParams = ChargeParams()
) -> DataFrame:
    """Counts and charges per region under both definitions; regions add up to the total.

    One aggregate over residue rows: sums combine before the shuffle, so only one row per chain
    and task moves, however long the chains are.
    """
    q = Q.residue_charge_simple(F.col("aa"))
    h = Q.residue_charge_ph(F.col("aa"), F.col("pos"), F.col("n"), p)
    tag = Q.definition_tag("ph", p)
    columns = []
    for r in REGIONS:
        inside = F.col("region") == r
        columns += [
            F.count_if(inside).alias(f"n_residues_{r}"),
            F.sum(F.when(inside, q).otherwise(0)).alias(f"charge_{r}_simple"),
            F.sum(F.when(inside, h).otherwise(0.0)).alias(f"charge_{r}_{tag}"),
        ]
    columns += [
        F.count(F.lit(1)).alias("n_residues_total"),
        F.sum(q).alias("charge_total_simple"),
        F.sum(h).alias(f"charge_total_{tag}"),
    ]
    return residues.groupBy(*keys).agg(*columns)


def shift_from(
    table: DataFrame, native: DataFrame, keys: Sequence[str], definitions: Sequence[str]
) -> DataFrame:
    """Adds charge_shift_<region>_<definition> against the native row of the same keys."""
    names = [f"{r}_{d}" for d in definitions for r in (*REGIONS, "total")]
    reference = native.select(*keys, *[F.col(f"charge_{n}").alias(f"_native_{n}") for n in names])
    joined = table.join(measured(reference), list(keys), "left")
    shifts = [(F.col(f"charge_{n}") - F.col(f"_native_{n}")).alias(f"charge_shift_{n}") for n in names]
    return joined.select(*table.columns, *shifts)


def density_simple(partitions: DataFrame) -> DataFrame:
    for r in REGIONS:
        partitions = partitions.withColumn(
            f"density_{r}", Q.density(F.col(f"charge_{r}_simple"), F.col(f"n_residues_{r}"))
        )
    return partitions


def region_counts(residues: DataFrame, keys: Sequence[str]) -> DataFrame:
    return residues.groupBy(*keys).pivot("region", list(REGIONS)).agg(F.count(F.lit(1))).na.fill(
        0, list(REGIONS)
    )


def definitions_present(table: DataFrame, prefix: str = "charge_shift_total_") -> list[str]:
    """Which charge definitions a wide table carries, read off its column names."""
    return sorted(c[len(prefix):] for c in table.columns if c.startswith(prefix))


def by_definition(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide shifts to one row per definition, for every definition found by prefix."""
    cells = [
        F.struct(
            F.lit(d).alias("definition"),
            *[F.col(f"charge_shift_{r}_{d}").cast("double").alias(f"shift_{r}") for r in (*REGIONS, "total")],
        )
        for d in definitions_present(table)
    ]
    return table.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def classify(df: DataFrame, core_max: float = 0.25) -> DataFrame:
    """core is tested first (strictly below the limit), then interface, else surface."""
    return df.withColumn(
        "region",
        F.when(F.col("relative_area") < core_max, "core")
        .when(F.col("in_interface"), "interface")
        .otherwise("surface"),
    )


def surface_positions(n, interface, core):
    """Array form of 'everything that is neither'."""
    return F.array_except(F.array_except(F.sequence(F.lit(0), n - 1), interface), core)
