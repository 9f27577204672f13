"""Numbered lines of text files, whatever their size and number.

Spark's text scan keeps a file's lines in order inside one split and says where the split starts.
Counting lines per split and adding the counts up gives line numbers without reading a file in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SPLIT = ("file", "block")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line_in_block, value); gzip is read as it is, blank lines stay."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    tagged = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_m"), "value")
    inside = W.partitionBy(*SPLIT).orderBy("_m")  # one split, bounded by the read split size
    return tagged.withColumn("line_in_block", F.row_number().over(inside)).drop("_m")


def running_count(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """How many flagged lines of the same file stand at or before each line."""
    marked = df.withColumn("_f", F.when(flag, 1).otherwise(0))
    totals = marked.groupBy(*SPLIT).agg(F.sum("_f").alias("_t"))
    in_file = W.partitionBy("file").orderBy("block")
    offsets = totals.select(*SPLIT, (F.sum("_t").over(in_file) - F.col("_t")).alias("_o"))
    inside = W.partitionBy(*SPLIT).orderBy("line_in_block").rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("_r", F.sum("_f").over(inside)).join(offsets, list(SPLIT)).withColumn(
        name, F.col("_r") + F.col("_o")).drop("_f", "_r", "_o")


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value), lines counted from 1."""
    return running_count(lines(spark, path), F.lit(True), "line").select("file", "line", "value")


def id_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Whitespace-separated ids, upper-case, in file order; `limit` keeps the first ones."""
    words = numbered(spark, path).select("file", "line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("place", "id"))
    words = words.where(F.col("id") != "").withColumn("id", F.upper("id"))
    return words if limit is None else words.orderBy("file", "line", "place").limit(limit)
