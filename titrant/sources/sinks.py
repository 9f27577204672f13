"""Table and summary sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from titrant.operators.joins import beside


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_doses(df: DataFrame, path: str, dose: str = "beta") -> None:
    """One partition per dose; a run replaces only the doses it holds. Rows of a dose are dealt
    over several tasks, so one popular dose does not become one writer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dose).parquet(path)


def in_order(df: DataFrame, first: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Known columns first, the rest by name, rows by key."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *sorted(c for c in df.columns if c not in lead)).orderBy(*[c for c in by if c in df.columns])


def write_summary(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON record: every section a single-row result, nested under its name."""
    (first, head), *rest = sections.items()
    out = head.select(F.struct("*").alias(first))
    for name, df in rest:
        out = beside(out, df.select(F.struct("*").alias(name)))
    out.write.mode("overwrite").json(path)
