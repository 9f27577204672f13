"""Row keys, written intermediates and Arrow scans that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from titrant.session import new_folder

#: Stands for a missing id inside the operators: it sorts after every other id.
NO_ID = 2**63 - 1
#: Words are runs of anything but blanks, as Java's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the job inside."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and safe when executors go. Shuffle
    files of the job go when it ends. `batch_bytes` bounds the Arrow batches of rows with long texts,
    which a task holds on both sides, Spark's and Python's."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{label}")
    with _set(spark, {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})):
        df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._titrant_path = path
    return again


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._titrant_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def back_to_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, th, text): the id, a hash of the text, and the text.

    The first two name a row even where an id repeats: rows that agree in both have the same text,
    so every decision about one holds for the other.
    """
    return docs.select(row_id().alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` applied to every Arrow batch of `df` inside the tasks."""

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def hash_filter(hashes: DataFrame, bits: int = 1 << 25) -> np.ndarray:
    """One bit per place of the 64-bit hashes in column `h`: a filter without false negatives.

    Its size is `bits`, whatever the number of hashes; a full one only lets more rows pass. Bits are
    gathered in Spark, so the driver reads at most one number per 64 bits.
    """
    place = F.pmod("h", F.lit(bits))
    held = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}L) & 63 as int))")).alias("held")
    )
    found = np.zeros(bits // 64, np.int64)
    for row in (words := written(held, "filter")).toLocalIterator():
        found[row.word] = row.held
    removed(words)
    return found.view(np.uint64)


def passing(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    place = hashes.view(np.int64) % np.int64(len(held) * 64)
    return (held[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
