"""The corpus pipeline: documents through five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of `documents`; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from titrant.llm import bottomk, decontamination, lines, mixing, toxicity
from titrant.llm.shared import WORD, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, nearly or exactly, go; n_chars follows the text. A document
    that thereby loses its last word goes as well; one that had none before stays."""
    found = lines.cleaned(docs).where((F.col("n_removed") == 0) | F.col("cleaned").rlike(WORD))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("cleaned"), "n_chars": F.when(changed, F.length("cleaned").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return bottomk.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each remaining document with how often its source's budget takes it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained network and a hash-seeded selection cannot be written in SQL; tests compare the run with
#: brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
