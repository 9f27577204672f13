"""Alphabet check of sequences."""

from pyspark.sql import DataFrame, Window as W, functions as F

from titrant.constants import ALPHABET


def bad_letters(df: DataFrame, key: str, seq: str, show: int = 5) -> DataFrame:
    """Per sequence and letter outside the alphabet: the first few zero-based positions.

    The rank filter is pushed below the shuffle by Spark, so each task sends at most `show` rows
    per (sequence, letter).
    """
    letters = df.select(key, F.posexplode(F.split(seq, "")).alias("pos", "letter")).where(
        ~F.col("letter").isin(*ALPHABET, "")
    )
    order = W.partitionBy(key, "letter").orderBy("pos")
    first = letters.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= show)
    return first.groupBy(key, "letter").agg(
        F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("positions")
    )
