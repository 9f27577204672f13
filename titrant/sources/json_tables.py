"""Nested JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from titrant.session import new_folder

FOLD_SCORES = "job string, ptm double, iptm double, plddt array<double>, pae array<array<double>>"
METRICS = "key string, complex string, beta double, replicate int, score double, wall double, device string"
DESIGNS_EXPORT = (
    "source string, proteins array<struct<entry: string, native_seq: string, "
    "designs: array<struct<sequence: string, beta: double, chain_net_charge: double>>>>"
)
_CHAIN = (
    "struct<sequence: string, relative_area: array<double>, interface_positions: array<int>, core_positions: array<int>>"
)
DEFINITIONS = f"definitions map<string, struct<label_source: string, chains: map<string, {_CHAIN}>>>"


def write_json(df: DataFrame, label: str) -> str:
    path = new_folder(df.sparkSession, label)
    df.write.json(path)
    return path


def read_fold_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLD_SCORES).json(path)


def read_definitions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Map of entries to maps of chains, as one row per (entry, chain)."""
    raw = spark.read.schema(DEFINITIONS).option("multiLine", multi_line).json(path)
    entries = raw.select(F.explode("definitions").alias("entry", "d"))
    return entries.select("entry", "d.label_source", F.explode("d.chains").alias("chain", "c")).select(
        "entry", "label_source", "chain", "c.*")


def read_designs_export(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """proteins to designs; a missing reported charge falls back to the simple count."""
    from titrant.functions.charge import net_charge_simple

    raw = spark.read.schema(DESIGNS_EXPORT).option("multiLine", multi_line).json(path)
    proteins = raw.select(F.explode("proteins").alias("p"))
    designs = proteins.select("p.entry", "p.native_seq", F.posexplode("p.designs").alias("replicate", "d"))
    return designs.select(
        "entry", "native_seq", "replicate", "d.sequence", "d.beta",
        F.coalesce("d.chain_net_charge", net_charge_simple(F.col("d.sequence")).cast("double")).alias("net_charge"))


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, unreadable records with their file): nothing is dropped in silence."""
    schema = T.StructType.fromDDL(METRICS + ", _corrupt string")
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.col("_metadata.file_path"))
    good = raw.where(F.col("_corrupt").isNull() & F.col("key").isNotNull()).drop("_corrupt")
    bad = raw.where(F.col("_corrupt").isNotNull() | F.col("key").isNull()).select("file", F.col("_corrupt").alias("record"))
    return good, bad
