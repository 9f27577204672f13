"""Atom records from fixed-width structure files, and chains made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from titrant import constants as K
from titrant.params import AtomParams
from titrant.sources.text_lines import lines, running_count

LINE = "%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s"


def element() -> Column:
    """The element of an atom line: columns 77-78, or what the atom's name says where they are blank.

    One-letter elements stand in column 14, behind a blank or a digit. A name that starts in column
    13 is a two-letter element, unless it fills all four columns, as the longer names of hydrogens
    do: then its first letter is the element.
    """
    name = F.upper(F.substring("value", 13, 4))
    inferred = (
        F.when(name.rlike("^[ 0-9][A-Z]"), F.substring(name, 2, 1))
        .when(name.rlike("^[A-Z]{1,2} *$"), F.trim(name))
        .otherwise(F.regexp_extract(name, "[A-Z]", 0))
    )
    stated = F.upper(F.trim(F.substring("value", 77, 2)))
    return F.when(stated.rlike("^[A-Z]"), stated).otherwise(inferred)


def read_atoms(spark: SparkSession, path: str, p: AtomParams = AtomParams()) -> DataFrame:
    """One model of every file under `path`; plain or gzip text."""
    counted = running_count(lines(spark, path), F.col("value").startswith("MODEL"), "_models")
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    number = lambda a, b, t: cut(a, b).try_cast(t)
    atom = F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")
    return counted.where(atom & (F.greatest(F.col("_models") - 1, F.lit(0)) == p.model_index)).select(
        "file", cut(1, 6).alias("record"), number(7, 11, "int").alias("serial"), cut(13, 16).alias("atom"), cut(17, 17).alias("altloc"),
        cut(18, 20).alias("resname"), cut(22, 22).alias("chain"), number(23, 26, "int").alias("seqid"), cut(27, 27).alias("icode"),
        number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"), element().alias("element"))


def residue_rows(atoms: DataFrame, group: str, order: str) -> DataFrame:
    """One row per residue in file order."""
    return atoms.groupBy(group, "chain", "seqid", "icode", "record", "resname").agg(F.min(order).alias("_first"))


def extract_chains(atoms: DataFrame, group: str, order: str, allow_charge_altering: bool = False) -> DataFrame:
    """Residues with a letter, a zero-based position or a problem.

    Foreign molecules are skipped unless they are known modified residues; a residue that cannot be
    scored is reported and takes no position. Positions are numbered inside one chain.
    """
    table = lambda d: F.create_map(*[F.lit(v) for item in d.items() for v in item])
    name = F.upper(F.trim("resname"))
    plain, changed = F.try_element_at(table(K.RESIDUE_LETTERS), name), F.try_element_at(table(K.MODIFIED_LETTERS), name)
    polymer = (F.col("record") == "ATOM") | changed.isNotNull()
    altering = name.isin(*K.CHARGE_ALTERING) & F.lit(not allow_charge_altering)
    problem = F.when(plain.isNull() & changed.isNull(), "unknown residue").when(plain.isNull() & altering, "charge-altering residue")
    rows = residue_rows(atoms, group, order).withColumn("skipped", ~polymer).withColumn(
        "problem", F.when(polymer, problem)).withColumn("modified", polymer & plain.isNull() & changed.isNotNull() & problem.isNull())
    good = polymer & problem.isNull()
    in_chain = W.partitionBy(group, "chain", good).orderBy("_first")
    return rows.withColumn("aa", F.when(good, F.coalesce(plain, changed))).withColumn("pos", F.when(good, F.row_number().over(in_chain) - 1))


def chain_audit(extracted: DataFrame, group: str) -> DataFrame:
    """Substitutions applied and foreign molecules skipped, per chain."""
    swap = F.when(F.col("modified"), F.struct("_first", F.concat("resname", F.lit(">"), "aa").alias("t")))
    return extracted.groupBy(group, "chain").agg(
        F.count("aa").alias("n_residues"), F.count_if("modified").alias("n_substituted"), F.count_if("skipped").alias("n_skipped"),
        F.count("problem").alias("n_problems"), F.array_sort(F.collect_list(swap)).alias("s")
    ).withColumn("substitutions", F.array_join(F.transform("s", lambda x: x["t"]), ",")).drop("s")


def chains_present(atoms: DataFrame, group: str, order: str) -> DataFrame:
    return atoms.groupBy(group, "chain").agg(F.min(order).alias("first_line"), F.count(F.lit(1)).alias("n_atoms")).orderBy(group, "first_line")


def positions_of(ids: DataFrame, extracted: DataFrame, group: str) -> DataFrame:
    """Residue ids to positions; an id that is not in the chain gets a problem."""
    known = extracted.where(F.col("pos").isNotNull()).select(group, "chain", "seqid", "icode", "pos")
    out = ids.join(known, [group, "chain", "seqid", "icode"], "left")
    return out.withColumn("problem", F.when(F.col("pos").isNull(), "unknown residue id"))


def render(atoms: DataFrame) -> Column:
    """A fixed-width line for an atom row."""
    return F.format_string(
        LINE, F.col("record"), F.col("serial"), F.col("atom"), F.col("altloc"), F.col("resname"), F.col("chain"), F.col("seqid").cast("int"),
        F.lit(" "), F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.lit(0.0), F.col("element"))
