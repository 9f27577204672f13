"""Scores from a square error matrix per job, kept as long rows (job, i, j, pae)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from titrant.functions.score import closeness, d0_array, d0_scalar


def matrix_rows(scores: DataFrame, key: str, matrix: str = "pae") -> DataFrame:
    """Nested array column to long rows."""
    rows = scores.select(key, F.posexplode(matrix).alias("i", "_row"))
    return rows.select(key, "i", F.posexplode("_row").alias("j", "pae"))


def well_shaped(long: DataFrame, first: int, second: int, key: str = "job") -> DataFrame:
    """(key, ok): a matrix that does not match the chain lengths is refused, never sliced."""
    n = first + second
    return long.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"), F.max("i").alias("mi"), F.max("j").alias("mj"),
    ).select(key, ((F.col("cells") == n * n) & (F.col("mi") == n - 1) & (F.col("mj") == n - 1)).alias("ok"))


def ipsae(long: DataFrame, first: int, second: int, cutoff: float, key: str = "job") -> DataFrame:
    """Three length normalisations, both directions, and the larger of the two.

    Everything is an aggregate over (job, direction, aligned residue); a residue without a
    confident partner scores 0 and stays in the maximum. A matrix that does not fit the lengths
    keeps its row, with null scores and a `problem`.
    """
    total = first + second
    side = F.when(F.col("i") < first, 0).otherwise(1)
    other = F.when(F.col("j") < first, 0).otherwise(1)
    shape = well_shaped(long, first, second, key)
    good = long.join(shape.where("ok"), key, "left_semi")
    cross = good.where(side != other).withColumn("direction", F.when(side == 0, "0to1").otherwise("1to0"))
    near = F.col("pae") < cutoff

    placed = cross.groupBy(key, "direction", "i").agg(F.count_if(near).alias("n_partners"))
    rows_in = placed.groupBy(key, "direction").agg(F.count_if(F.col("n_partners") > 0).alias("_rows"))
    cols_in = cross.where(near).groupBy(key, "direction", "j").agg(F.lit(1).alias("_x")).groupBy(key, "direction").agg(
        F.count(F.lit(1)).alias("_cols"))
    size = rows_in.join(cols_in, [key, "direction"], "left").select(
        key, "direction", (F.col("_rows") + F.coalesce("_cols", F.lit(0))).alias("n_interface"))

    scored = cross.where(near).join(placed, [key, "direction", "i"]).join(size, [key, "direction"])
    per_residue = scored.groupBy(key, "direction", "i").agg(
        F.avg(closeness(F.col("pae"), d0_array(F.col("n_partners")))).alias("d0res"),
        F.avg(closeness(F.col("pae"), d0_scalar(F.col("n_interface")))).alias("d0dom"),
        F.avg(closeness(F.col("pae"), d0_scalar(F.lit(total)))).alias("d0chn"))
    names = ("d0res", "d0dom", "d0chn")
    best = per_residue.groupBy(key, "direction").agg(*[F.max(n).alias(n) for n in names])
    both = size.join(best, [key, "direction"], "left").na.fill(0.0, list(names))
    wide = both.groupBy(key).agg(
        *[F.max(F.when(F.col("direction") == d, F.col(n))).alias(f"{n}_{d}") for n in (*names, "n_interface") for d in ("0to1", "1to0")])
    for n in names:
        wide = wide.withColumn(n, F.greatest(f"{n}_0to1", f"{n}_1to0"))
    problem = F.when(F.col("ok"), F.lit(None).cast("string")).otherwise("matrix does not fit the chain lengths")
    return shape.withColumn("problem", problem).drop("ok").join(wide, key, "left")


def block_means(long: DataFrame, first: int, second: int, key: str = "job") -> DataFrame:
    """Mean of the two cross blocks; null where the matrix does not fit the lengths."""
    upper = (F.col("i") < first) & (F.col("j") >= first)
    lower = (F.col("i") >= first) & (F.col("j") < first)
    means = long.groupBy(key).agg(
        ((F.avg(F.when(upper, F.col("pae"))) + F.avg(F.when(lower, F.col("pae")))) / 2).alias("_m"))
    return means.join(well_shaped(long, first, second, key), key).select(
        key, F.when(F.col("ok"), F.col("_m")).alias("interface_pae"))


def chain_means(vectors: DataFrame, key: str, vector: str, first: int) -> DataFrame:
    """Mean confidence per chain over the two slices of one vector."""
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(a))
    return vectors.select(
        key, mean(F.slice(vector, 1, first)).alias("first_chain"),
        mean(F.slice(F.col(vector), F.lit(first + 1), F.greatest(F.size(vector) - first, F.lit(0)))).alias("second_chain"),
        mean(F.col(vector)).alias("overall"))
