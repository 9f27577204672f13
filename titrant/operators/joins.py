"""Joins against a side whose size is measured before it is sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from titrant.session import keep

BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 200_000_000


def measured(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast when its rows and texts are within the bounds; otherwise as it
    is, for a shuffle join that adaptive execution splits where a key is hot."""
    kept = keep(df)
    texts = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = kept.agg(F.count(F.lit(1)).alias("n"), (sum(texts) if texts else F.lit(0)).alias("chars")).first()
    return F.broadcast(kept) if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS else kept


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result to every row, as one scalar subquery and not a join."""
    row = single.select(F.struct(*single.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in single.columns])
