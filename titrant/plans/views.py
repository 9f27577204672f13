"""The study tables (sequences, residues, dose grids, atoms, error matrices, jobs), bound to the
given parquet tables. Every view covers its whole table and whole texts; the moduli below label
rows with a dose, a chain or a region and never leave one out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from titrant.constants import ALPHABET
from titrant.operators.threading import Backbone


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores (one small file) is dealt out; a large scan is left alone."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark, sf_dir) -> DataFrame:
    """One row per document: its text reduced to residue letters, a lineage and a dose label. A text
    without such letters is found by its first one, since a test of the reduced text reduces it again."""
    keep = ALPHABET + ALPHABET.lower()
    docs = spread_scan(table(spark, sf_dir, "documents"))
    return docs.where(F.col("text").rlike(f"[{keep}]")).select(
        "doc_id",
        "source",
        "lang",
        (F.col("doc_id") % 5 * 1.5 - 3.0).alias("beta"),
        F.upper(F.regexp_replace("text", f"[^{keep}]", "")).alias("seq"),
    )


def natives(sequences: DataFrame) -> DataFrame:
    """The first document of each lineage stands for its native sequence."""
    return sequences.groupBy("source", "lang").agg(
        F.min(F.struct("doc_id", "seq")).alias("_first")
    ).select("source", "lang", F.col("_first.doc_id").alias("native_id"), F.col("_first.seq").alias("native_seq"))


def residues(spark, sf_dir) -> DataFrame:
    """One row per residue with a region label."""
    s = seqs(spark, sf_dir).withColumn("n", F.length("seq"))
    long = s.select(
        "doc_id", "source", "lang", "beta", "n", F.posexplode(F.split("seq", "")).alias("pos", "aa")
    )
    return long.withColumn("region", region_label(F.col("pos")))


def region_label(pos):
    return F.when(pos % 4 == 0, "interface").when(pos % 4 == 1, "core").otherwise("surface")


def grid(spark, sf_dir) -> DataFrame:
    """Metric per lineage (part, flag) and dose; many lineages lack some doses."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_linenumber") - 1).cast("double").alias("beta"),
    ).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        "part", "flag", "beta",
        (F.col("cents") / F.col("n")).alias("score"),
        (F.col("qty") / F.col("n")).alias("conf"),
    )


LINEAGE = ("part", "flag")


def resp(spark, sf_dir) -> DataFrame:
    """Charge and size per complex (supplier), dose and region."""
    li = table(spark, sf_dir, "lineitem")
    region = (
        F.when(F.col("l_returnflag") == "A", "interface")
        .when(F.col("l_returnflag") == "R", "core")
        .otherwise("surface")
    )
    return li.groupBy(
        F.col("l_suppkey").alias("complex"),
        (F.col("l_linenumber") - 1).cast("double").alias("beta"),
        region.alias("region"),
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("charge"),
        F.count(F.lit(1)).alias("size"),
    )


ATOM_NAMES = (
    "N CA C O CB NZ NE NH1 NH2 ND1 NE2 OD1 OD2 OE1 OE2 CG CD CE CZ SD HA".split()
)
RES_NAMES = "LYS ARG HIS ASP GLU GLY ALA SER LEU TRP".split()
RESIDUES_PER_STRUCTURE = 50


def atoms(spark, sf_dir, chains: int = 2) -> DataFrame:
    """21 atoms per embedding: a residue centre from the first three floats, and an offset from
    each later triple. 50 consecutive embeddings make one structure, so structures grow in number
    with the table and not in size."""
    e = spread_scan(table(spark, sf_dir, "embeddings"))
    names = F.array(*[F.lit(a) for a in ATOM_NAMES])
    resnames = F.array(*[F.lit(r) for r in RES_NAMES])
    chain_ids = F.array(*[F.lit(c) for c in "ABCD"[:chains]])
    slot = F.col("vec_id") % RESIDUES_PER_STRUCTURE
    base = e.select(
        F.floor(F.col("vec_id") / RESIDUES_PER_STRUCTURE).alias("structure"),
        F.get(chain_ids, (slot % chains).cast("int")).alias("chain"),
        F.floor(slot / chains).alias("pos"),
        F.get(resnames, F.col("label")).alias("resname"),
        "vec_id",
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(len(ATOM_NAMES) - 1))).alias("k"),
    )

    def coordinate(axis: int):
        centre = F.get("embedding", F.lit(axis)).cast("double") * 60.0
        offset = F.get("embedding", F.col("k") * 3 + axis).cast("double") * 8.0
        return F.round(centre + offset, 3)

    out = base.select(
        "structure", "chain", "pos", "resname", "vec_id",
        F.get(names, F.col("k")).alias("atom"),
        F.when(F.col("k") == 18, "B").when(F.col("k") == 17, "A").otherwise("").alias("altloc"),
        F.substring(F.get(names, F.col("k")), 1, 1).alias("element"),
        coordinate(0).alias("x"), coordinate(1).alias("y"), coordinate(2).alias("z"),
    )
    return out.where(~((F.col("resname") == "GLY") & (F.col("atom") == "CB")))


BACKBONE_LETTERS = "KADLERGSHW"


def backbone_length(structure, n):
    """Every seventh document's backbone lacks the last residue, so its sequence does not fit."""
    return F.when((structure % 7 == 3) & (n > 1), n - 1).otherwise(n)


def backbone_lengths(spark, sf_dir) -> DataFrame:
    """One row per document: how many residues each chain of its backbone has."""
    s = seqs(spark, sf_dir).select(F.col("doc_id").alias("structure"), F.length("seq").cast("bigint").alias("n"))
    return s.select("structure", backbone_length(F.col("structure"), F.col("n")).alias("n"))


def backbone_letter(structure, pos, other):
    place = (structure * 3 + pos * 7 + F.when(other, 5).otherwise(0)) % 10
    return F.substring(F.lit(BACKBONE_LETTERS), (place + 1).cast("int"), F.lit(1))


def backbone_place(pos, other):
    """Coordinates are quarters, so distances are exact."""
    return (
        (((pos * 5) % 18) * 0.5 - 4.25 + F.when(other, 5.0).otherwise(0.0)).cast("double").alias("x"),
        (((pos * 7) % 11) * 0.5 - 2.5).cast("double").alias("y"), (pos * 1.5).cast("double").alias("z"),
    )


def _length_array(structure, n):
    return np.where((np.fmod(structure, 7) == 3) & (n > 1), n - 1, n)


#: The letter for each remainder from -9 to 9, as `substring` counts its places.
_LETTER_BYTES = np.array([ord(BACKBONE_LETTERS[p if p >= 0 else min(p + 1, 0)]) for p in range(-9, 10)], np.uint8)


def _letter_array(structure, pos, other):
    return _LETTER_BYTES[np.fmod(structure * 3 + pos * 7 + (5 if other else 0), 10) + 9]


def _place_array(pos, other):
    return (pos * 5 % 18) * 0.5 - 4.25 + (5.0 if other else 0.0), (pos * 7 % 11) * 0.5 - 2.5, pos * 1.5


#: The same backbones as functions of arrays.
BACKBONE = Backbone(_length_array, _letter_array, _place_array)


def texts(spark, sf_dir) -> DataFrame:
    """Documents as the backbones know them, with their texts as they are."""
    return spread_scan(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("structure"), "text")


def backbones(spark, sf_dir) -> DataFrame:
    """Two chains for each document, as long as its sequence, with native letters on them. Glycines
    have no CB and stand with their CA."""
    chains = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("chain")
    each = backbone_lengths(spark, sf_dir).select("structure", chains, "n").select(
        "structure", "chain", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("pos"))
    other = F.col("chain") == "B"
    placed = each.withColumn("aa", backbone_letter(F.col("structure"), F.col("pos"), other))
    return placed.select(
        "structure", "chain", "pos", "aa", F.when(F.col("aa") == "G", "CA").otherwise("CB").alias("atom"), F.lit("").alias("altloc"),
        *backbone_place(F.col("pos"), other),
    )


def polymer(spark, sf_dir) -> DataFrame:
    """Atom records as a structure file holds them, with modified, foreign and unknown residues."""
    a = atoms(spark, sf_dir)
    v = F.col("vec_id")
    het = (v % 29 == 0) | (v % 31 == 0) | (v % 37 == 0)
    names = F.array(*[F.lit(n) for n in ATOM_NAMES])
    return a.select(
        "structure", "chain", (F.col("pos") + 1).alias("seqid"), F.lit("").alias("icode"), "vec_id", "atom", "altloc", "element", "x", "y", "z",
        F.when(v % 29 == 0, "MSE").when(v % 31 == 0, "HOH").when(v % 37 == 0, "SEP").when(v % 41 == 0, "UNK").otherwise(F.col("resname")).alias("resname"),
        F.when(het, "HETATM").otherwise("ATOM").alias("record"),
        (v % RESIDUES_PER_STRUCTURE * len(ATOM_NAMES) + F.array_position(names, F.col("atom"))).cast("int").alias("serial"),
    )


MATRIX_SIDE, FIRST_CHAIN = 32, 20


def pae(spark, sf_dir) -> DataFrame:
    """Error matrices in long form: 16 embeddings hold the 32 x 32 values of one job."""
    e = spread_scan(table(spark, sf_dir, "embeddings"))
    cells = e.select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return cells.select(
        F.floor(F.col("vec_id") / 16).alias("job"),
        (F.col("vec_id") % 16 * 2 + F.floor(F.col("k") / 32)).alias("i"),
        (F.col("k") % 32).cast("bigint").alias("j"),
        (F.abs(F.col("v").cast("double")) * 60.0).alias("pae"),
    )


def jobs(spark, sf_dir) -> DataFrame:
    """One row per event: a job of a complex (user), its order, outcome and wall time."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    device = F.when(k % 3 == 0, "gpu").when(k % 3 == 1, "cpu")
    return ev.select(
        F.col("event_id").alias("key"),
        F.col("user_id").alias("complex"),
        "ts",
        (F.col("event_id") % 5 * 1.5 - 3.0).alias("beta"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("wall"),
        k.alias("k"),
        device.alias("device"),
        (F.lit(50) + F.col("user_id") * 37 % 1200).alias("residues"),
    )


def folded(spark, sf_dir) -> DataFrame:
    """External fold scores, joined later on the document."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        (F.col("quality") == 1).alias("folded"),
        (F.col("n_chars") / 1000.0).alias("rmsd"),
    )


#: Documents with scores whose ids are sent to every task, 8 bytes and a hash table's place each.
SCORED_IDS = 2_000_000


def scored(spark, sf_dir, sequences: DataFrame) -> DataFrame:
    """The sequences that fold scores exist for, found by id before anything is computed of them. With
    more ids than a task should hold it is all sequences: a join by id would move their texts."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return sequences.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SCORED_IDS else sequences


# ---- raw text tables for the contract checks -------------------------------------------------

def raw_designs(spark, sf_dir) -> DataFrame:
    """Design rows as text, one per order, with every kind of malformed cell among them."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    tail = F.substring(F.md5(ck.cast("string").cast("binary")), 1, 3)
    plain = F.concat((ck % 9 + 1).cast("string"), tail)
    letters = F.translate(F.md5(ok.cast("string").cast("binary")), "0123456789abcdef", "ACDEFGHIKLMNPQRS")
    return o.select(
        ok.alias("row_id"),
        F.when(ok % 11 == 0, "").when(ok % 11 == 1, F.concat(F.lit("X"), tail))
        .when(ok % 11 == 2, " n/a ").otherwise(plain).alias("pdb_id"),
        F.when(ck % 5 == 0, "A").when(ck % 5 == 1, "A,B").when(ck % 5 == 2, "A,A")
        .when(ck % 5 == 3, " A , C").otherwise("A,,B").alias("designed_chain"),
        F.when(ok % 4 == 0, "B").when(ok % 4 == 1, "D").when(ok % 4 == 2, "E-F").otherwise("A").alias("fixed_chain"),
        F.when(ok % 6 == 0, "0.0").when(ok % 6 == 1, "-1.5").when(ok % 6 == 2, "nan")
        .when(ok % 6 == 3, "inf").when(ok % 6 == 4, "abc").otherwise(" 3 ").alias("beta"),
        F.when(ok % 7 == 0, "0").when(ok % 7 == 1, "1").when(ok % 7 == 2, "-1").when(ok % 7 == 3, "1.5")
        .when(ok % 7 == 4, "3.0").when(ok % 7 == 5, "2").otherwise("+4").alias("replicate"),
        F.when(ok % 8 == 0, F.concat(letters, F.lit("X"))).when(ok % 8 == 1, F.lower(letters))
        .when(ok % 8 == 2, "").otherwise(letters).alias("sequence"),
        F.when(F.col("o_orderpriority") == "5-LOW", "N/A")
        .otherwise((ok % 41 - 20).cast("string")).alias("net_charge_reported"),
    )


def designs(spark, sf_dir) -> DataFrame:
    """Typed designs for the table-level checks: keys repeat and lengths vary in some groups."""
    o = table(spark, sf_dir, "orders")
    ck = F.col("o_custkey")
    chain = F.when(ck % 3 == 0, "A").when(ck % 3 == 1, "B").otherwise("C")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("1"), F.lpad(F.conv(ck.cast("string"), 10, 36), 3, "0")).alias("pdb_id"),
        F.array(chain).alias("designed_chain"),
        F.when(ck % 7 == 0, F.array(chain)).otherwise(F.array(F.lit("D"))).alias("fixed_chain"),
        (F.col("o_orderkey") % 5 * 1.5 - 3.0).alias("beta"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("replicate"),
        F.repeat(F.lit("A"), (F.lit(30) + F.when(F.col("o_orderpriority") == "1-URGENT", ck % 2).otherwise(0)).cast("int")).alias("sequence"),
    )


def raw_test_set(spark, sf_dir) -> DataFrame:
    """Two-chain entries, one per customer, with repeated ids, wrong arity and leaking clusters."""
    c = table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    return c.select(
        ck.alias("row_id"),
        F.when(ck % 50 == 0, "1AAA")
        .otherwise(F.concat(F.lit("1"), F.lpad(F.conv(ck.cast("string"), 10, 36), 3, "0"))).alias("pdb_id"),
        F.when(ck % 20 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("C")))
        .when(ck % 3 == 0, F.array(F.lit("A"), F.lit("D")))
        .otherwise(F.array(F.lit("B"), F.lit("D"))).alias("chains"),
        F.concat_ws("-", F.col("c_mktsegment"), F.floor(ck / 10).cast("string")).alias("cluster"),
        F.when(F.col("c_nationkey") < 3, "train").otherwise("test").alias("split"),
        F.col("c_nationkey").alias("nation"),
    )
