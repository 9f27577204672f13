"""Deviation of one region after fitting two structures on another chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

BACKBONE = ("N", "CA", "C", "O")


def pair_residues(native: DataFrame, predicted: DataFrame, group: str = "structure") -> DataFrame:
    """Residues of equal chain, ordinal and letter."""
    other = predicted.select(group, "chain", "pos", F.col("aa").alias("_aa"))
    return native.select(group, "chain", "pos", "aa").join(other, [group, "chain", "pos"]).where(F.col("aa") == F.col("_aa")).drop("_aa")


def paired_atoms(native: DataFrame, predicted: DataFrame, pairs: DataFrame, group: str = "structure") -> DataFrame:
    """Backbone atoms of paired residues that are complete on both sides."""
    keys = [group, "chain", "pos", "atom"]
    n = native.where(F.col("atom").isin(*BACKBONE)).select(*keys, "x", "y", "z")
    p = predicted.where(F.col("atom").isin(*BACKBONE)).select(*keys, *[F.col(a).alias(f"p{a}") for a in "xyz"])
    both = n.join(p, keys).join(pairs.select(group, "chain", "pos"), [group, "chain", "pos"], "left_semi")
    whole = both.groupBy(group, "chain", "pos").agg(F.count_distinct("atom").alias("k")).where(F.col("k") == len(BACKBONE))
    return both.join(whole, [group, "chain", "pos"], "left_semi")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(cross: pd.Series) -> pd.Series:
    """Best proper rotation for each 3x3 cross-moment matrix; a row per structure, never its atoms."""
    m = np.stack([np.asarray(c, dtype=float).reshape(3, 3) for c in cross]) if len(cross) else np.empty((0, 3, 3))
    u, _, vt = np.linalg.svd(m)
    sign = np.sign(np.linalg.det(u @ vt))
    vt[:, 2, :] *= sign[:, None]
    return pd.Series(list((u @ vt).reshape(-1, 9)))


def fits(atoms: DataFrame, group: str = "structure") -> DataFrame:
    """(group, n, centres, rotation) from moment sums; a structure is never gathered."""
    sums = [F.avg(f"{s}{a}").alias(f"m{s}{a}") for s in ("", "p") for a in "xyz"]
    cross = [F.covar_pop(f"p{a}", b).alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    m = atoms.groupBy(group).agg(F.count(F.lit(1)).alias("n_atoms"), *sums, *cross)
    return m.withColumn("rotation", _rotation(F.array(*[F.col(f"c{a}{b}") for a in "xyz" for b in "xyz"])))


def deviation(atoms: DataFrame, fit: DataFrame, group: str = "structure") -> DataFrame:
    """Root mean square distance per group once the predicted side is moved by its fit."""
    joined = atoms.join(fit, group)
    d = F.lit(0.0)
    for j, b in enumerate("xyz"):
        moved = F.col(f"m{b}")
        for i, a in enumerate("xyz"):
            moved = moved + (F.col(f"p{a}") - F.col(f"mp{a}")) * F.col("rotation")[i * 3 + j]
        d = d + (F.col(b) - moved) * (F.col(b) - moved)
    return joined.groupBy(group).agg(F.sqrt(F.avg(d)).alias("rmsd"), (F.count(F.lit(1)) / len(BACKBONE)).cast("bigint").alias("n_residues"))


def interface_rmsd(
    native: DataFrame, predicted: DataFrame, pairs: DataFrame, interface: DataFrame, designed: str, partner: str,
    group: str = "structure", min_pairs: int = 10,
) -> DataFrame:
    """Interface deviation of the designed chain, fitted on the partner; null with a reason otherwise."""
    atoms = paired_atoms(native, predicted, pairs, group)
    fixed = atoms.where(F.col("chain") == partner)
    fit = fits(fixed, group)
    usable = fit.where(F.col("n_atoms") >= min_pairs * len(BACKBONE))
    moving = atoms.where(F.col("chain") == designed).join(interface.select(group, "chain", "pos").distinct(), [group, "chain", "pos"], "left_semi")
    inner = deviation(moving, usable, group).select(group, F.col("rmsd").alias("interface_rmsd"), F.col("n_residues").alias("n_compared"))
    base = deviation(fixed, usable, group).select(group, F.col("rmsd").alias("superposition_rmsd"))
    every = native.select(group).distinct().join(fit.select(group, "n_atoms"), group, "left")
    out = every.join(inner, group, "left").join(base, group, "left")
    few = F.coalesce("n_atoms", F.lit(0)) < min_pairs * len(BACKBONE)
    return out.withColumn("note", F.when(few, "too few partner residues paired").when(F.col("interface_rmsd").isNull(), "no interface residue paired")).drop("n_atoms")
