"""Strict CSV: every cell is text, headers are checked, line numbers are those of the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from titrant.operators.joins import measured
from titrant.operators.validation import TableSpec
from titrant.session import new_folder
from titrant.sources.text_lines import numbered


def write_csv(df: DataFrame, label: str) -> str:
    path = new_folder(df.sparkSession, label)
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


#: A cell behind its comma: quoted, with doubled or escaped quotes inside, or plain. Possessive, so
#: that a long cell neither backtracks nor recurses.
_CELL = r',("(?:[^"\\]++|\\.|"")*+"(?=,|$)|[^,]*+)'


def cells(line: Column) -> Column:
    """The cells of one line, quotes taken off."""

    def bare(c: Column) -> Column:
        inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.when(_quoted(c), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(c)

    return F.transform(_raw_cells(line), bare)


def _raw_cells(line: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))


def _quoted(c: Column) -> Column:
    return c.startswith('"') & c.endswith('"') & (F.length(c) > 1)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) for every file that holds a line, the names as they stand without outer
    blanks. The first line is found by one map-side aggregation; no line is sorted or moved."""
    first = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
        .where("b = 0").groupBy("file").agg(F.min_by("value", "m").alias("value"))
    )
    return first.select("file", F.transform(cells(F.col("value")), lambda c: F.trim(c)).alias("header"))


def header_problems(spark: SparkSession, path: str, spec: TableSpec, allow_extra: bool = False) -> DataFrame:
    """(file, kind, column_name) for duplicate, missing and unexpected columns, and for a file
    without any line (kind "empty file", no column).

    The header is read as text: the CSV reader renames a repeated column and so hides it.
    """
    expected = F.array(*[F.lit(c) for c in spec.names])
    # Scans leave out files of no length, the listing that Spark keeps of its inputs does not.
    listed = spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()
    every = spark.createDataFrame([(x,) for x in listed], "file string")
    one_slash = F.regexp_replace("file", "^([a-z0-9]+):///", "$1:/")  # the two write an absent host differently
    found = headers(spark, path).select(one_slash.alias("file"), "header")
    seen = every.withColumn("file", one_slash).join(found, "file", "left").withColumn("h", F.coalesce("header", F.array().cast("array<string>")))
    repeated = F.array_distinct(F.filter("h", lambda c: F.size(F.filter("h", lambda o: o == c)) > 1))
    kinds = [("duplicate", repeated), ("missing", F.array_except(expected, "h"))]
    if not allow_extra:
        kinds.append(("unexpected", F.array_except("h", expected)))

    def labelled(kind, names):
        return F.transform(names, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("column_name")))

    empty = F.array(F.struct(F.lit("empty file").alias("kind"), F.lit(None).cast("string").alias("column_name")))
    problems = F.when(F.col("header").isNull(), empty).otherwise(F.flatten(F.array(*[labelled(kind, columns) for kind, columns in kinds])))
    return seen.select("file", F.explode(problems).alias("p")).select("file", "p.*")


def read_strict(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(file, line, columns as text, row_problem). Cells belong to the column that their file's
    header names, wherever it stands; a column that the header lacks is empty. Nothing is inferred
    and no text is taken for a missing value. A blank line stays as a row of empty cells.

    `row_problem` tells of a row with more or fewer cells than its header, and of a quote left open
    (quoted cells may not contain line breaks); it is null for all other rows.
    """
    rows = numbered(spark, path).where("line > 1").withColumns({"c": cells(F.col("value")), "raw": _raw_cells(F.col("value"))})
    named = rows.join(measured(headers(spark, path)), "file")
    blank, n = F.trim("value") == "", F.size("header")
    problem = (
        F.when(blank, None)
        .when(F.exists("raw", lambda c: c.startswith('"') & ~_quoted(c)), "quote left open")
        .when(F.size("c") != n, F.concat(F.size("c").cast("string"), F.lit(" cells under "), n.cast("string"), F.lit(" columns")))
    )
    place = {name: F.array_position("header", F.lit(name)).cast("int") for name in columns}
    cell = {name: F.when(at > 0, F.try_element_at("c", at)) for name, at in place.items()}
    return named.select("file", "line", *[F.coalesce(x, F.lit("")).alias(name) for name, x in cell.items()], problem.alias("row_problem"))
