"""Connected components of an undirected graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from titrant.llm.shared import removed, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; a component is named by its smallest node.

    Alternates two steps until no link changes: each node ties its larger neighbours to the least
    node it sees, then its smaller ones. Rounds grow with the logarithm of the longest chain. Each
    round is one job over the links, written to the shared folder, so a lost executor repeats one
    round at most; a node with any number of neighbours is only aggregated and joined.
    """
    now = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    print_of = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == print_of or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        print_of = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(now)
        now = after
