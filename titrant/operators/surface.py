"""Solvent accessible area by sphere points, and the regions that follow from it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from titrant import constants as K
from titrant.operators.regions import classify
from titrant.operators.spatial import contact_residues, grid_join, heavy, residue_contacts, squared_distance
from titrant.params import RegionParams


# Pairs of an atom and a neighbour whose sphere points one step holds.
PAIRS = 20_000


def lattice(n: int) -> list[tuple[float, float, float]]:
    """Evenly spread unit vectors: equal steps in z, golden-angle turns around it."""
    turn = math.pi * (3.0 - math.sqrt(5.0))
    out = []
    for k in range(n):
        z = 1.0 - (2.0 * k + 1.0) / n
        r = math.sqrt(1.0 - z * z)
        out.append((round(r * math.cos(k * turn), 12), round(r * math.sin(k * turn), 12), round(z, 12)))
    return out


def with_radius(atoms: DataFrame) -> DataFrame:
    r = None
    for element, radius in K.ATOM_RADII.items():
        r = F.when(F.col("element") == element, radius) if r is None else r.when(F.col("element") == element, radius)
    return atoms.withColumn("radius", r.otherwise(K.OTHER_RADIUS))


def _free_points(p: RegionParams, columns: Sequence[str]):
    """Per atom, how many points of its sphere no neighbour covers: among those of its own chain, and
    among all. Points and neighbours of a block of atoms meet as arrays."""
    unit, probe = np.array(lattice(p.sphere_points)), p.probe_radius

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = batch["near"]
        first = near.offsets.to_numpy().astype(np.int64)
        flat = near.values.flatten() if pa.types.is_struct(near.type.value_type) else []
        ox, oy, oz, reach, same = (f.to_numpy(zero_copy_only=False) for f in flat)
        x, y, z, radius = (batch[c].to_numpy() for c in ("x", "y", "z", "radius"))
        free = np.full((2, len(x)), p.sphere_points, np.int64)
        low = 0
        while low < len(x):
            high = max(low + 1, int(np.searchsorted(first, first[low] + PAIRS, side="right")) - 1)
            some = np.flatnonzero(np.diff(first[low : high + 1])) + low
            if len(some):
                owner = np.repeat(np.arange(low, high), np.diff(first[low : high + 1]))
                pairs = slice(first[low], first[high])
                big = radius[owner] + probe
                d = [(c[owner, None] + unit[None, :, k] * big[:, None]) - o[pairs, None] for k, (c, o) in enumerate(((x, ox), (y, oy), (z, oz)))]
                covered = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < (reach[pairs] * reach[pairs])[:, None]
                starts = first[some] - first[low]
                free[1, some] -= np.logical_or.reduceat(covered, starts).sum(axis=1)
                free[0, some] -= np.logical_or.reduceat(covered & same[pairs, None].astype(bool), starts).sum(axis=1)
            low = high
        return pa.RecordBatch.from_arrays([*(batch[c] for c in columns), batch["radius"], pa.array(free[0]), pa.array(free[1])], [*columns, "radius", "alone", "bound"])

    return lambda batches: (count(b) for b in batches)


def exposed(
    atoms: DataFrame, keys: Sequence[str], residue: Sequence[str], p: RegionParams = RegionParams(), inner: Column | None = None
) -> DataFrame:
    """(residue, isolated, bound): accessible area per residue among the atoms that share `keys`, and
    among those that share `inner` as well.

    One join on grid cells gives every atom the atoms that reach into its sphere, an array as long as
    atoms fit there. All points of the sphere are then tested against it for both scopes at once, so
    points never become rows.
    """
    names = [*dict.fromkeys([*keys, *residue])]
    owner = [*names, "atom"]
    sized = with_radius(atoms).select(*owner, "x", "y", "z", "radius", (F.lit(True) if inner is None else inner).alias("_inner"))
    other = sized.select(
        *keys, "x", "y", "z", F.col("radius").alias("o_radius"), F.col("_inner").alias("o_inner"), F.struct(*owner).alias("o_owner"))
    widest = 2 * (max(*K.ATOM_RADII.values(), K.OTHER_RADIUS) + p.probe_radius)
    reach = F.col("radius") + F.col("o_radius") + 2 * p.probe_radius
    meets = (squared_distance() < reach * reach) & (F.struct(*[F.col(f"l.{c}") for c in owner]) != F.col("o_owner"))
    near = F.when(F.col("o_x").isNotNull(), F.struct(
        "o_x", "o_y", "o_z", (F.col("o_radius") + p.probe_radius).alias("reach"), (F.col("_inner") == F.col("o_inner")).alias("same")))
    found = grid_join(sized, other, widest, keys, "left", limit=meets).groupBy(*owner, "x", "y", "z", "radius").agg(F.collect_list(near).alias("near"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*names).schema)
    points = found.select(*names, "x", "y", "z", "radius", "near").mapInArrow(_free_points(p, names), f"{shape}, radius double, alone bigint, bound bigint")
    big = F.col("radius") + p.probe_radius
    area = lambda c: F.sum(F.col(c) * (big * big * (4.0 * math.pi / p.sphere_points)))
    return points.groupBy(*residue).agg(area("alone").alias("isolated"), area("bound").alias("bound"))


def residue_area(
    atoms: DataFrame, keys: Sequence[str], residue: Sequence[str], p: RegionParams = RegionParams()
) -> DataFrame:
    """Accessible area per residue among the atoms that share `keys`."""
    return exposed(atoms, keys, residue, p).select(*residue, F.col("bound").alias("area"))


def burial(atoms: DataFrame, p: RegionParams = RegionParams(), group: str = "structure") -> DataFrame:
    """Isolated and bound area per residue and what complexation buries (never below 0)."""
    areas = exposed(atoms, [group], [group, "chain", "pos", "resname"], p, F.col("chain"))
    return areas.withColumn("delta", F.greatest(F.lit(0.0), F.col("isolated") - F.col("bound")))


def by_delta(areas: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Strictly above the threshold."""
    return areas.where(F.col("delta") > threshold)


def relative_area(df: DataFrame, area: str = "isolated", aa: str = "aa") -> DataFrame:
    table = F.create_map(*[F.lit(v) for item in K.MAX_ASA.items() for v in item])
    return df.withColumn("relative_area", F.col(area) / F.try_element_at(table, F.col(aa)))


def delta_summary(areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    some = F.col("delta") > 0
    return areas.groupBy(*keys).agg(
        F.sum("delta").alias("total"), F.max("delta").alias("largest"),
        F.coalesce(F.avg(F.when(some, F.col("delta"))), F.lit(0.0)).alias("mean_nonzero"),
        F.count_if(some).alias("n_nonzero"))


def agreement(first: DataFrame, second: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Overlap of two residue sets per group; Jaccard is 0 for two empty sets."""
    l = first.select(*keys).distinct().withColumn("_a", F.lit(True))
    r = second.select(*keys).distinct().withColumn("_b", F.lit(True))
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    out = l.join(r, list(keys), "full_outer").groupBy(group).agg(
        F.count_if(a).alias("n_first"), F.count_if(b).alias("n_second"), F.count_if(a & b).alias("n_both"),
        F.count_if(a & ~b).alias("n_first_only"), F.count_if(b & ~a).alias("n_second_only"), F.count(F.lit(1)).alias("_union"))
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("n_both"), F.col("_union")), F.lit(0.0))).drop("_union")


def letters(resname):
    table = F.create_map(*[F.lit(v) for item in (K.RESIDUE_LETTERS | K.MODIFIED_LETTERS).items() for v in item])
    return F.try_element_at(table, F.upper(F.trim(resname)))


def define_regions(
    atoms: DataFrame, a: str = "A", b: str = "B", p: RegionParams = RegionParams(), source: str = "native",
    group: str = "structure",
) -> tuple[DataFrame, DataFrame]:
    """(residues with areas and a region, contact residues): both definitions for every complex."""
    h = heavy(atoms).where(F.col("chain").isin(a, b))
    areas = burial(h, p, group).withColumn("aa", letters(F.col("resname")))
    marked = relative_area(areas).withColumn("in_interface", F.col("delta") > p.delta_area_threshold)
    touching = contact_residues(residue_contacts(atoms, a, b, p.contact_cutoff, group), group)
    return classify(marked, p.core_relative_area_max).withColumn("label_source", F.lit(source)), touching


def require_native(regions: DataFrame) -> DataFrame:
    """Labels made on anything but a native structure move with the dose: refused at run time."""
    ok = F.col("label_source") == "native"
    refuse = F.raise_error(F.lit("charge partitions need labels with source 'native'")).cast("boolean")
    return regions.where(F.when(ok, F.lit(True)).otherwise(refuse))  # a filter stays whatever is selected
