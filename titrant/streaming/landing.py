"""Result files picked up as they land, each key once, with an account of every record."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from titrant.sources.json_tables import METRICS

#: Landed keys are dealt over this many hash partitions, so each batch meets them without one sort.
BUCKETS = 16
_BAD = "_unreadable"
COLUMNS = [c.split()[0] for c in METRICS.split(",")]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def unreadable_at(out: str) -> str:
    return f"{out.rstrip('/')}-unreadable"


def counts_at(out: str) -> str:
    return f"{out.rstrip('/')}-counts"


def _land(out: str, run: str, buckets: int):
    """Writes one batch. A batch has one folder per table, named by the stream and its number, and
    overwrites it, so a batch that is done again after a failure neither repeats nor loses a record."""

    def land(batch: DataFrame, number: int) -> None:
        spark, label = batch.sparkSession, f"batch={run}-{number}"
        batch = batch.persist()
        readable = F.col("key").isNotNull() & F.col(_BAD).isNull()
        batch.where(~readable).select("_file", F.coalesce(_BAD, F.to_json(F.struct(*COLUMNS))).alias("record")).write.mode("overwrite").parquet(f"{unreadable_at(out)}/{label}")
        # Of records with one key, the first file's, then the least record.
        first = batch.where(readable).groupBy("key").agg(F.min(F.struct("_file", F.to_json(F.struct(*COLUMNS)).alias("_text"), F.struct(*COLUMNS).alias("row"))).alias("one"))
        fresh = first.select("one.row.*").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        if _exists(spark, out):
            known = spark.read.schema("key string, bucket int, batch string").parquet(out).where(F.col("batch") != f"{run}-{number}").select("bucket", "key")
            fresh = fresh.join(known, ["bucket", "key"], "left_anti")
        where = f"{out.rstrip('/')}/{label}"
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(where)
        landed = spark.read.schema("key string").parquet(where).agg(F.count("key").alias("n_landed"))
        seen = batch.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~readable).alias("n_unreadable"))
        seen.crossJoin(landed).select(
            "n_records", "n_landed", (F.col("n_records") - F.col("n_unreadable") - F.col("n_landed")).alias("n_repeated"), "n_unreadable"
        ).write.mode("overwrite").parquet(f"{counts_at(out)}/{label}")
        batch.unpersist()

    return land


def collect_landed(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100, buckets: int = BUCKETS) -> None:
    """One catch-up run over files not seen before.

    Which files were seen lives in the checkpoint folder; which keys were, in `out` itself: a batch
    keeps those that an anti join does not find there, so no state grows inside the stream. Records
    that cannot be read, or have no key, go to `unreadable_at(out)` with their file; `account` adds
    up where every record went.
    """
    landed = (
        spark.readStream.schema(f"{METRICS}, {_BAD} string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(folder)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    query = landed.writeStream.foreachBatch(_land(out, run, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def landed(spark: SparkSession, out: str) -> DataFrame:
    """The records that landed, one per key."""
    return spark.read.schema(METRICS).parquet(out).select(*COLUMNS)


def unreadable(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("_file string, record string").parquet(unreadable_at(out)).select(F.col("_file").alias("file"), "record")


def account(spark: SparkSession, out: str) -> DataFrame:
    """One row: records read, and how many of them landed, repeated a key, or were unreadable."""
    names = ("n_records", "n_landed", "n_repeated", "n_unreadable")
    counts = spark.read.schema(", ".join(f"{n} bigint" for n in names)).parquet(counts_at(out))
    return counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def missing(expected: DataFrame, landed: DataFrame, key: str = "key") -> DataFrame:
    return expected.join(landed.select(key), key, "left_anti")
