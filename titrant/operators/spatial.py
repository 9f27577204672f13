"""Distance joins over atomic coordinates, by grid cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from titrant import constants as K
from titrant.functions.bridge import or_zero
from titrant.params import AtomParams, BridgeParams

AXES = ("x", "y", "z")


def heavy(atoms: DataFrame, p: AtomParams = AtomParams()) -> DataFrame:
    keep = F.col("altloc").isin(*p.altlocs)
    return atoms.where(keep & (F.col("element") != "H") if p.drop_hydrogens else keep)


def submodel(atoms: DataFrame, chains: Sequence[str], p: AtomParams = AtomParams()) -> DataFrame:
    """Named chains without hydrogens and foreign molecules; alternate locations stay."""
    out = atoms.where(F.col("chain").isin(*chains))
    if "record" in atoms.columns:
        out = out.where((F.col("record") == "ATOM") | F.upper(F.trim("resname")).isin(*K.MODIFIED_LETTERS))
    return out.where(F.col("element") != "H") if p.drop_hydrogens else out


def squared_distance(left: str = "", right: str = "o_") -> Column:
    d = [F.col(f"{left}{a}") - F.col(f"{right}{a}") for a in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _cells(df: DataFrame, prefix: str, size: float) -> DataFrame:
    for a in AXES:
        df = df.withColumn(f"_c{a}", F.floor(F.col(f"{prefix}{a}") / size).cast("int"))
    return df


def with_cells(df: DataFrame, reach: float) -> DataFrame:
    """The cell of each row. Cells are a hair wider than twice the reach, so that a partner exactly at
    the reach is never lost through rounding."""
    return _cells(df, "", 2 * reach * 1.000001)


def with_near_cells(df: DataFrame, reach: float) -> DataFrame:
    """Each row once per cell that its reach touches, coordinates renamed to o_x, o_y, o_z. A reach to
    both sides is as long as one cell, so it touches two along each axis and eight in all."""
    wide, out = reach * 1.000001, df
    for a in AXES:
        out = out.withColumn(f"_c{a}", F.floor((F.col(a) - wide) / (2 * wide)).cast("int")).withColumnRenamed(a, f"o_{a}")
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    for k, a in enumerate(AXES):
        out = out.withColumn(f"_c{a}", F.col(f"_c{a}") + F.shiftright("_k", k).bitwiseAND(F.lit(1)))
    return out.drop("_k")


def grid_join(
    left: DataFrame, right: DataFrame, reach: float, keys: Sequence[str], how: str = "inner",
    limit: Column | None = None,
) -> DataFrame:
    """Pairs within `reach` (inclusive), each once: an equi join on (keys, cell).

    A structure of any size spreads over its cells; only the smaller side should be `right`, which
    is copied to 8 cells. Columns of `right` other than keys must not clash with `left`.
    """
    cells = [f"_c{a}" for a in AXES]
    near = squared_distance() <= reach * reach if limit is None else limit
    l, r = with_cells(left, reach).alias("l"), with_near_cells(right, reach).alias("r")
    on = near
    for c in (*keys, *cells):
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    joined = l.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(*cells)
    keep = [F.col(f"l.{c}") for c in left.columns]
    keep += [F.col(f"r.{c}") for c in r.columns if c not in (*keys, *cells)]
    return joined.select(*keep)


def _other(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for n in names:
        df = df.withColumnRenamed(n, f"o_{n}")
    return df


def atom_contacts(atoms: DataFrame, a: str, b: str, cutoff: float, group: str = "structure") -> DataFrame:
    """Cross-chain heavy atom pairs within the cutoff."""
    h = heavy(atoms).select(group, "chain", "pos", "resname", *AXES)
    left, right = h.where(F.col("chain") == a), h.where(F.col("chain") == b)
    pairs = grid_join(left, _other(right, ["chain", "pos", "resname"]), cutoff, [group])
    return pairs.withColumn("distance", F.sqrt(squared_distance()))


def residue_contacts(atoms: DataFrame, a: str, b: str, cutoff: float, group: str = "structure") -> DataFrame:
    """Smallest heavy-atom distance per residue pair; minima combine before the shuffle."""
    return atom_contacts(atoms, a, b, cutoff, group).groupBy(group, "chain", "pos", "resname", "o_chain", "o_pos", "o_resname").agg(
        F.min("distance").alias("distance"))


def contact_residues(contacts: DataFrame, group: str = "structure") -> DataFrame:
    """Residues of either side that touch the other."""
    one = contacts.select(group, "chain", "pos")
    two = contacts.select(group, F.col("o_chain").alias("chain"), F.col("o_pos").alias("pos"))
    return one.unionByName(two).distinct()


def best_partner(atoms: DataFrame, cutoff: float, group: str = "structure") -> DataFrame:
    """For every chain, the chain that touches most of its residues; ties by name; none, null."""
    h = heavy(atoms).select(group, "chain", "pos", *AXES)
    touching = grid_join(h, _other(h, ["chain", "pos"]), cutoff, [group],
                         limit=(squared_distance() <= cutoff * cutoff) & (F.col("l.chain") != F.col("r.o_chain")))
    n = touching.select(group, "chain", "o_chain", "pos").distinct().groupBy(group, "chain", "o_chain").agg(
        F.count(F.lit(1)).alias("n_contacts"))
    best = n.groupBy(group, "chain").agg(F.min(F.struct(-F.col("n_contacts"), F.col("o_chain"))).alias("b"))
    best = best.select(group, "chain", F.col("b.o_chain").alias("partner"), (-F.col("b.col1")).alias("n_contacts"))
    return h.select(group, "chain").distinct().join(best, [group, "chain"], "left")


# ---- charged pairs -----------------------------------------------------------------------------

def charged_atoms(atoms: DataFrame, p: BridgeParams = BridgeParams(), definition: str = "geometric", alt: AtomParams = AtomParams()) -> DataFrame:
    """Atoms a definition measures between, with the sign of their residue."""
    positive = {r: a for r, a in K.POSITIVE_ATOMS.items() if r != "HIS" or p.histidine}
    name = F.upper(F.trim("resname"))
    sign = F.when(name.isin(*positive), 1).when(name.isin(*K.NEGATIVE_ATOMS), -1)
    signed = atoms.where(F.col("altloc").isin(*alt.altlocs)).withColumn("sign", sign).where(F.col("sign").isNotNull())
    if definition == "cbeta_proxy":
        return signed.where(F.col("atom") == "CB")
    wanted = F.lit(False)
    for residue, names in (positive | K.NEGATIVE_ATOMS).items():
        wanted = wanted | ((name == residue) & F.col("atom").isin(*names))
    return signed.where(wanted)


def charged_population(residues: DataFrame, group: str = "structure") -> DataFrame:
    """Signed residues to the counts behind every normalisation."""
    return residues.groupBy(group).agg(
        F.count_if(F.col("sign") > 0).alias("n_cationic"), F.count_if(F.col("sign") < 0).alias("n_anionic"),
    ).withColumn("n_charged", F.col("n_cationic") + F.col("n_anionic")).withColumn(
        "n_opportunities", F.col("n_cationic") * F.col("n_anionic"))


def opposite_pairs(charged: DataFrame, cutoff: float, group: str = "structure", cross_chain: bool = False) -> DataFrame:
    """Distinct residue pairs of opposite charge, however many atom pairs join them."""
    c = charged.select(group, "chain", "pos", "sign", *AXES)
    pairs = grid_join(c.where("sign > 0").drop("sign"), _other(c.where("sign < 0").drop("sign"), ["chain", "pos"]), cutoff, [group])
    if cross_chain:
        pairs = pairs.where(F.col("chain") != F.col("o_chain"))
    return pairs.select(group, "chain", "pos", "o_chain", "o_pos").distinct()


def bridge_counts(pairs: DataFrame, population: DataFrame, group: str = "structure") -> DataFrame:
    """One row per structure of the population; structures without a bridge count 0."""
    n = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n_bridges"))
    engaged = contact_residues(pairs, group).groupBy(group).agg(F.count(F.lit(1)).alias("n_engaged"))
    return population.join(n, group, "left").join(engaged, group, "left").na.fill(0, ["n_bridges", "n_engaged"])


def scoped_counts(pairs: DataFrame, population: DataFrame, group: str = "structure") -> DataFrame:
    """Both scopes from one pair table: every pair counts in 'all', those between chains also in
    'cross_chain'. Population rows without a bridge count 0 in each."""
    both = F.array(F.lit("all"), F.lit("cross_chain"))
    scopes = F.when(F.col("chain") != F.col("o_chain"), both).otherwise(F.slice(both, 1, 1))
    scoped = pairs.withColumn("scope", F.explode(scopes))
    ends = F.array(F.struct("chain", "pos"), F.struct(F.col("o_chain").alias("chain"), F.col("o_pos").alias("pos")))
    long = scoped.select(group, "scope", "chain", "pos", "o_chain", "o_pos", F.explode(ends).alias("end"))
    n = long.groupBy(group, "scope").agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("n_bridges"), F.count_distinct("end").alias("n_engaged"))
    every = population.withColumn("scope", F.explode(both))
    return every.join(n, [group, "scope"], "left").na.fill(0, ["n_bridges", "n_engaged"])


def signed_residues(atoms: DataFrame, p: BridgeParams = BridgeParams(), group: str = "structure") -> DataFrame:
    positive = [r for r in K.POSITIVE_ATOMS if r != "HIS" or p.histidine]
    name = F.upper(F.trim("resname"))
    sign = F.when(name.isin(*positive), 1).when(name.isin(*K.NEGATIVE_ATOMS), -1)
    return atoms.select(group, "chain", "pos", sign.alias("sign")).where(F.col("sign").isNotNull()).distinct()


def count_bridges(atoms: DataFrame, definition: str = "geometric", cross_chain: bool = False, p: BridgeParams = BridgeParams(), group: str = "structure") -> DataFrame:
    cutoff = p.cutoff if definition == "geometric" else p.proxy_cutoff
    pairs = opposite_pairs(charged_atoms(atoms, p, definition), cutoff, group, cross_chain)
    return bridge_counts(pairs, charged_population(signed_residues(atoms, p, group), group), group)


def threaded(atoms: DataFrame, letters: DataFrame, p: BridgeParams = BridgeParams(), group: str = "structure") -> tuple[DataFrame, DataFrame]:
    """(CB atoms with signs, signed residues) for letters (group, chain, pos, aa) on the backbone.

    A charged letter on a residue without a CB atom stays in the population and never in a pair.
    """
    positive = "KRH" if p.histidine else "KR"
    sign = F.when(F.col("aa").isin(*positive), 1).when(F.col("aa").isin("D", "E"), -1)
    signed = letters.withColumn("sign", sign).where(F.col("sign").isNotNull()).select(group, "chain", "pos", "sign")
    cb = atoms.where((F.col("atom") == "CB") & F.col("altloc").isin(*AtomParams().altlocs)).select(group, "chain", "pos", *AXES)
    return cb.join(signed, [group, "chain", "pos"]), signed


def count_threaded(atoms: DataFrame, letters: DataFrame, cross_chain: bool = False, p: BridgeParams = BridgeParams(), group: str = "structure") -> DataFrame:
    cb, signed = threaded(atoms, letters, p, group)
    return bridge_counts(opposite_pairs(cb, p.proxy_cutoff, group, cross_chain), charged_population(signed, group), group)


# ---- charge products over contacts -------------------------------------------------------------

def pair_product(qa: Column, qb: Column, distance: Column, weight: str = "none") -> Column:
    product = qa.cast("double") * qb
    if weight == "inverse_distance":
        return product / F.greatest(distance, F.lit(1e-6))
    if weight != "none":
        raise ValueError(f"unknown weight {weight!r}")
    return product


def complementarity(pairs: DataFrame, group: str, product: str = "product", count_neutral: bool = False) -> DataFrame:
    """Neutral pairs never change the sum; they enter the mean's denominator only when asked."""
    v = F.col(product)
    out = pairs.groupBy(group).agg(
        F.sum(v).alias("sum_product"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(v < 0).alias("n_attractive"),
        F.count_if(v > 0).alias("n_repulsive"), F.count_if(v == 0).alias("n_neutral"))
    counted = F.col("n_pairs") if count_neutral else F.col("n_attractive") + F.col("n_repulsive")
    return out.withColumn("mean_product", or_zero(F.col("sum_product"), F.nullif(counted, F.lit(0))))
