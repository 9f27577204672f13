"""Dose-response slopes per complex and region, and the matched null behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from titrant.operators.ordering import hash_index, hash_order
from titrant.operators.regions import REGIONS


def slope(y: Column | str, x: Column | str) -> Column:
    """Least squares slope as an aggregate; null when x does not vary (the built-in one raises)."""
    return F.try_divide(F.covar_pop(y, x), F.nullif(F.var_pop(x), F.lit(0.0)))


def region_shifts(resp: DataFrame, key: str, dose: str = "beta", reference: float = 0.0) -> DataFrame:
    """Long (key, dose, region, charge, size) to one wide row of shifts per (key, dose)."""
    cells = []
    for r in REGIONS:
        inside = F.col("region") == r
        cells += [
            F.sum(F.when(inside, F.col("charge")).otherwise(0)).alias(f"charge_{r}"),
            F.sum(F.when(inside, F.col("size")).otherwise(0)).alias(f"n_residues_{r}"),
        ]
    wide = resp.groupBy(key, dose).agg(*cells)
    wide = wide.withColumn("charge_total", sum(F.col(f"charge_{r}") for r in REGIONS))
    wide = wide.withColumn("n_residues_total", sum(F.col(f"n_residues_{r}") for r in REGIONS))
    names = (*REGIONS, "total")
    one = wide.where(F.col(dose) == reference).select(key, *[F.col(f"charge_{r}").alias(f"_ref_{r}") for r in names])
    return wide.join(one, key).select(
        key, dose, *[f"n_residues_{r}" for r in names],
        *[(F.col(f"charge_{r}") - F.col(f"_ref_{r}")).cast("double").alias(f"charge_shift_{r}_simple") for r in names],
    )


def region_slopes(
    shifts: DataFrame, keys: Sequence[str], definition: str = "simple", dose: str = "beta", min_doses: int = 3
) -> DataFrame:
    """Slope of each region's shift on the whole shift against the region's share of residues.

    All three regions come out of one aggregate per complex: one shuffle, three rows out.
    """
    total = f"charge_shift_total_{definition}"
    sizes = [F.min_by(f"n_residues_{r}", dose).alias(f"n_residues_{r}") for r in (*REGIONS, "total")]
    fitted = shifts.groupBy(*keys).agg(
        F.count_distinct(dose).alias("n_betas"),
        *sizes,
        *[slope(f"charge_shift_{r}_{definition}", total).alias(f"_slope_{r}") for r in REGIONS],
    ).where((F.col("n_betas") >= min_doses) & (F.col("n_residues_total") > 0))
    cells = [
        F.struct(
            F.lit(r).alias("region"),
            F.col(f"n_residues_{r}").alias("n_residues_region"),
            F.col(f"_slope_{r}").alias("slope"),
        )
        for r in REGIONS
    ]
    long = fitted.select(*keys, "n_betas", "n_residues_total", F.explode(F.array(*cells)).alias("c"))
    share = F.col("n_residues_region") / F.col("n_residues_total")
    return (
        long.select(*keys, "c.*", "n_residues_total", "n_betas")
        .where(F.col("slope").isNotNull())
        .withColumn("residue_share", share)
        .withColumn("slope_minus_share", F.col("slope") - F.col("residue_share"))
        .withColumn("ratio", F.when(F.col("residue_share") > 0, F.col("slope") / F.col("residue_share")))
    )


def region_gap(slopes: DataFrame, key: str, left: str = "interface", right: str = "surface") -> DataFrame:
    """(key, left, right, gap), only complexes with both ratios."""
    wide = slopes.groupBy(key).pivot("region", [left, right]).agg(F.avg("ratio"))
    wide = wide.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return wide.withColumn("gap", F.col(left) - F.col(right))


def position_slopes(residues: DataFrame, keys: Sequence[str], charge: str, total: str) -> DataFrame:
    """Slope of each position's charge on the whole charge; slopes of positions add up.

    Keyed by (lineage, position), so a lineage with very many designs spreads over its positions.
    """
    return residues.groupBy(*keys, "pos").agg(
        slope(charge, total).alias("slope"), F.count(F.lit(1)).alias("n_designs")
    ).where(F.col("slope").isNotNull())


def stratum(area: str, width: float) -> Column:
    return F.floor(F.col(area) / width)


def matched_draws(
    positions: DataFrame, key: str, area: str, *, width: float, n_draws: int, seed: int
) -> DataFrame:
    """Per replicate, as many surface positions as there are interface ones in each area stratum,
    without replacement, in hash order, each beside the target it stands for (both in order of their
    stratum). (key, rep, pos, slope, area, wanted_area); a stratum short of surface positions gives
    all it has, and the shortfall shows in the sample size."""
    binned = positions.withColumn("_stratum", stratum(area, width))
    inside = W.partitionBy(key, "_stratum")
    targets = binned.where("region = 'interface'").select(
        key, "_stratum", F.col(area).alias("wanted_area"), (F.row_number().over(inside.orderBy(area, "pos")) - 1).cast("bigint").alias("slot"))
    wanted = targets.groupBy(key, "_stratum").agg(F.count(F.lit(1)).alias("_wanted"))
    pool = binned.where("region = 'surface'").join(wanted, [key, "_stratum"])
    each = pool.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    order = hash_order(F.lit(str(seed)), F.col(key), F.col("rep"), F.col("pos"))
    placed = hash_index(each, [key, "_stratum", "rep"], order, width=2).where(F.col("slot") < F.col("_wanted"))
    return placed.join(targets, [key, "_stratum", "slot"]).select(key, "rep", "_stratum", "pos", "slope", area, "wanted_area")


def matched_null(
    positions: DataFrame, key: str, area: str, *, width: float = 0.1, n_draws: int = 10_000, seed: int = 0
) -> DataFrame:
    """Observed interface ratio against surface samples matched by area stratum, with an add-one
    p-value; `matching_null.nearest_null` matches by nearest value instead.

    `mean_match_error` is the mean over targets of |chosen - wanted| and `n_sampled` the number of
    matched targets, fewer than the interface where strata are short. Every complex has a row: one
    without an interface, with fewer surface than interface positions, or without any match, has the
    reason in `status` and nulls for the rest.
    """
    inside, outside = F.col("region") == "interface", F.col("region") == "surface"
    observed = positions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_residues"), F.count_if(inside).alias("n_interface"),
        F.count_if(outside).alias("n_surface_pool"), F.sum(F.when(inside, F.col("slope"))).alias("_sum"),
        F.avg(F.when(inside, F.col(area))).alias("mean_area_interface"),
        F.avg(F.when(outside, F.col(area))).alias("mean_area_surface"),
    )
    share = F.try_divide(F.col("n_interface").cast("double"), F.col("n_residues"))
    observed = observed.withColumn("observed_ratio", F.try_divide(F.col("_sum"), share))
    fit = observed.where("n_interface > 0 AND n_surface_pool >= n_interface").select(key, "n_residues", "observed_ratio")
    sample = matched_draws(positions, key, area, width=width, n_draws=n_draws, seed=seed)
    per_rep = sample.groupBy(key, "rep").agg(
        F.sum("slope").alias("_s"), F.count(F.lit(1)).alias("_k"), F.avg(F.abs(F.col(area) - F.col("wanted_area"))).alias("_error"))
    joined = per_rep.join(fit, key).withColumn("_ratio", F.col("_s") / (F.col("_k") / F.col("n_residues")))
    centre = joined.groupBy(key).agg(
        F.avg("_ratio").alias("null_mean_ratio"), F.try_divide(
            F.stddev_pop("_ratio") * F.sqrt(F.count(F.lit(1)).cast("double")),
            F.sqrt(F.count(F.lit(1)).cast("double") - 1)).alias("null_sd_ratio"))
    both = joined.join(centre, key)
    extreme = F.abs(F.col("_ratio") - F.col("null_mean_ratio")) >= F.abs(F.col("observed_ratio") - F.col("null_mean_ratio"))
    tested = both.groupBy(key).agg(
        ((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p_permutation"),
        F.max("_k").alias("n_sampled"), F.avg("_error").alias("mean_match_error"))
    status = F.when(F.col("n_interface") == 0, "skipped: no interface").when(
        F.col("n_surface_pool") < F.col("n_interface"), "skipped: surface pool smaller than interface").when(
        F.col("n_sampled").isNull(), "skipped: no stratum in common").when(
        F.col("n_sampled") < F.col("n_interface"), "matched in part").otherwise("matched")
    return (
        observed.drop("_sum").join(centre, key, "left").join(tested, key, "left").withColumn("status", status)
        .withColumn("observed_ratio", F.when(F.col("n_sampled").isNotNull(), F.col("observed_ratio")))
        .withColumn("n_sampled", F.coalesce("n_sampled", F.lit(0)))
        .withColumn("observed_minus_null", F.col("observed_ratio") - F.col("null_mean_ratio"))
    )


def two_term_fit(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Ordinary least squares on a constant and two columns, from moments of one pass."""
    m = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"), F.var_pop(y).alias("syy"),
    )
    det = F.nullif(F.expr("s11 * s22 - s12 * s12"), F.lit(0.0))
    out = m.withColumn("b1", F.try_divide(F.expr("s1y * s22 - s2y * s12"), det)).withColumn(
        "b2", F.try_divide(F.expr("s2y * s11 - s1y * s12"), det))
    return out.select(
        "n", F.try_divide(F.col("s1y"), F.nullif(F.sqrt(F.col("s11") * F.col("syy")), F.lit(0.0))).alias("correlation"),
        F.expr("my - b1 * m1 - b2 * m2").alias("intercept"), F.col("b1").alias("coefficient_1"),
        F.col("b2").alias("coefficient_2"))
