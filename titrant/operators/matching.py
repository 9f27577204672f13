"""Which chain an exported sequence came from."""

from pyspark.sql import DataFrame, functions as F

from titrant.functions.identity import identity


def match_chain(
    exports: DataFrame, chains: DataFrame, key: list[str], policy: str = "raise", prefer: str | None = None,
    min_identity: float = 0.95,
) -> DataFrame:
    """exports(key, native_seq), chains(key, chain_id, seq) to one row per export with a status.

    One export meets its own candidates only, and candidates shrink to one row per (export,
    identity) map-side, so many copies of a chain cost no more than one.
    """
    both = exports.join(chains, key, "left").withColumn("_gap", F.length("seq") - F.length("native_seq"))
    scored = both.withColumn("_id", F.when(F.col("_gap") == 0, identity(F.col("seq"), F.col("native_seq"))))
    by_score = scored.groupBy(*key, "_id").agg(
        F.count("chain_id").alias("n"), F.min("chain_id").alias("lowest"),
        (F.max(F.col("chain_id").cast("string") == prefer) if prefer else F.lit(False)).alias("preferred"),
        F.min(F.struct(F.abs("_gap").alias("size"), F.col("chain_id").alias("chain"), F.col("_gap").alias("gap"))).alias("near"))
    best = by_score.groupBy(*key).agg(
        F.max(F.when(F.col("_id").isNotNull(), F.struct("_id", "n", "lowest", "preferred"))).alias("b"), F.min("near").alias("near"))
    none, low, tied = F.col("b").isNull(), F.col("b._id") < min_identity, F.col("b.n") > 1
    take = F.lit(policy == "first")
    status = (
        F.when(none, "no chain of that length").when(low, "identity too low").when(~tied, "matched")
        .when(F.col("b.preferred"), "tie, preferred chain").when(take, "tie, first chain").otherwise("ambiguous"))
    ok = ~none & ~low & (~tied | F.col("b.preferred") | take)
    chosen = F.when(F.col("b.preferred") & tied, F.lit(prefer)).otherwise(F.col("b.lowest").cast("string"))
    return best.select(
        *key, status.alias("status"), F.when(ok, chosen).alias("chain_id"), F.col("b._id").alias("identity"),
        F.col("b.n").alias("n_best"), F.when(none, F.col("near.chain")).alias("nearest_chain"),
        F.when(none, F.col("near.gap")).alias("nearest_gap"))
