"""File inventories: digests, indexes, comparison and drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from titrant.sources.text_lines import lines, running_count


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_if_present(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> tuple[DataFrame, bool]:
    """An absent optional input becomes an empty table of the declared schema, and says so."""
    if exists(spark, path):
        return spark.read.schema(schema).format(fmt).load(path), True
    return spark.createDataFrame([], schema), False


def digests(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """(path, sha256, bytes) per file; only whole-file hashing needs the content column."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select((F.col("path") if name is None else name).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def stem(path: Column) -> Column:
    """Upper-case file name without its suffix, a final .gz taken off first."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?i)\\.gz$", "")
    return F.upper(F.regexp_replace(base, "\\.[^.]*$", ""))


def index(spark: SparkSession, path: str, suffixes: Sequence[str], name: Column | None = None) -> DataFrame:
    """One file per stem, first path wins. Listing only: the content column is never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    wanted = "|".join(s.lstrip(".") for s in suffixes)
    found = found.where(F.lower("path").rlike(f"\\.({wanted})(\\.gz)?$"))
    return found.groupBy((stem(F.col("path")) if name is None else name).alias("stem")).agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("n_files"))


def coordinate_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_in_block, text): atom records only, right-trimmed."""
    atom = F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")
    return lines(spark, path).where(atom).withColumn("text", F.regexp_replace("value", r"\s+$", "")).drop("value")


def coordinate_digest(spark: SparkSession, path: str, name: Column) -> DataFrame:
    """Order-sensitive digest per file from per-line hashes, so no file is gathered anywhere."""
    placed = running_count(coordinate_lines(spark, path), F.lit(True), "place")
    one, two = F.xxhash64("place", "text"), F.xxhash64("text", "place", F.lit(1))
    return placed.groupBy(name.alias("stem")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2"))


def compare(spark: SparkSession, left: str, right: str, name: Callable[[Column], Column]) -> DataFrame:
    """(stem, status): identical, same coordinates, different, only left, only right."""
    def side(path, tag):
        whole = digests(spark, path, name(F.col("path"))).select(F.col("path").alias("stem"), F.col("sha256").alias(f"{tag}_sha"))
        inner = coordinate_digest(spark, path, name(F.col("file"))).select("stem", F.struct("n_lines", "h1", "h2").alias(f"{tag}_xyz"))
        return whole.join(inner, "stem", "left")

    both = side(left, "l").join(side(right, "r"), "stem", "full_outer")
    return both.select("stem", F.when(F.col("r_sha").isNull(), "only left").when(F.col("l_sha").isNull(), "only right")
                       .when(F.col("l_sha") == F.col("r_sha"), "identical").when(F.col("l_xyz") == F.col("r_xyz"), "same coordinates")
                       .otherwise("different").alias("status"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded digests against the files as they are: ok, changed or missing."""
    now = current.select("path", F.col("sha256").alias("_now"))
    return recorded.join(now, "path", "left").withColumn(
        "status", F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed").otherwise("ok")).drop("_now")


def run_record(inputs: DataFrame, parameters: dict, seeds: dict) -> DataFrame:
    """Canonical JSON (sorted fields, no spaces) over inputs, parameters and seeds, and its digest.

    Outputs and time stay out, so equal runs share a hash. The inputs enter as their number, size
    and an order-free combination of one digest per file, which adds up map-side: any number of
    files makes a record of one line.
    """
    record = lambda d: F.struct(*[F.lit(d[k]).alias(k) for k in sorted(d)])
    each = F.sha2(F.concat_ws("|", "path", F.col("bytes").cast("string"), "sha256"), 256)
    words = [F.bit_xor(F.conv(F.substring(each, at, 15), 16, 10).cast("bigint")).cast("string") for at in (1, 16, 31, 46)]
    merged = inputs.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.concat_ws("-", *words).alias("digest"), F.count(F.lit(1)).alias("files"))
    body = merged.select(F.to_json(F.struct(
        F.struct("bytes", "digest", "files").alias("inputs"), record(parameters).alias("parameters"), record(seeds).alias("seeds"))).alias("record"))
    return body.withColumn("run_hash", F.sha2("record", 256))
