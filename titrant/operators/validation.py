"""Row and table contracts. Every problem becomes a row; nothing is dropped in silence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from titrant import constants as K, session
from titrant.operators.joins import beside

ENTRY_ID = "^[0-9][A-Za-z0-9]{3}$"
CHAIN_ID = "^[A-Za-z0-9]{1,4}$"
INTEGER = "^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Cell:
    value: Column
    problem: Column  # null when the cell is fine


def cleaned(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")


def is_placeholder(raw: Column) -> Column:
    return F.lower(cleaned(raw)).isin(*K.PLACEHOLDERS)


def _cell(raw: Column, value: Column, *checks: tuple[Column, str]) -> Cell:
    problem = F.when(is_placeholder(raw), "empty or placeholder")
    for broken, text in checks:
        problem = problem.when(broken, text)
    return Cell(F.when(problem.isNull(), value), problem)


def entry_id(raw: Column) -> Cell:
    t = cleaned(raw)
    return _cell(raw, F.upper(t), (~t.rlike(ENTRY_ID), "not an entry id"))


def chain_list(raw: Column) -> Cell:
    parts = F.transform(F.split(cleaned(raw), ","), lambda p: F.trim(p))
    return _cell(
        raw, parts, (F.exists(parts, lambda p: p == ""), "empty chain id"),
        (~F.forall(parts, lambda p: p.rlike(CHAIN_ID)), "not a chain id"),
        (F.size(F.array_distinct(parts)) < F.size(parts), "repeated chain id"))


def finite_float(raw: Column) -> Cell:
    t = F.lower(cleaned(raw))
    value = t.try_cast("double")
    special = t.rlike("^[+-]?(inf|infinity|nan)$")
    return _cell(raw, F.when(t.rlike(NUMBER), value), (special | (F.abs(value) == float("inf")), "not finite"), (~t.rlike(NUMBER), "not a number"))


def strict_int(minimum: int | None = None) -> Callable[[Column], Cell]:
    def parse(raw: Column) -> Cell:
        t = cleaned(raw)
        value = F.when(t.rlike(INTEGER), t).try_cast("bigint")
        checks = [(~t.rlike(INTEGER), "not an integer"), (t.rlike(INTEGER) & value.isNull(), "out of range")]
        if minimum is not None:
            checks.append((value < minimum, f"below {minimum}"))
        return _cell(raw, value, *checks)

    return parse


def sequence_text(raw: Column) -> Cell:
    t = F.replace(F.upper(cleaned(raw)), F.lit(" "), F.lit(""))
    return _cell(raw, t, (F.regexp_replace(t, f"[{K.ALPHABET}]", "") != "", "letter outside the alphabet"))


def split_name(raw: Column) -> Cell:
    t = F.lower(cleaned(raw))
    return _cell(raw, t, (~t.isin("train", "test"), "not train or test"))


def identifier(raw: Column) -> Cell:
    return _cell(raw, cleaned(raw))


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    parse: Callable[[Column], Cell]
    kind: str
    doc: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


DESIGNS = TableSpec("designs", (
    ColumnSpec("pdb_id", entry_id, "entry id", "structure the design belongs to"),
    ColumnSpec("designed_chain", chain_list, "chain list", "chains that were redesigned"),
    ColumnSpec("fixed_chain", chain_list, "chain list", "chains held native"),
    ColumnSpec("beta", finite_float, "finite number", "dose"),
    ColumnSpec("replicate", strict_int(0), "integer, 0 or more", "replicate index"),
    ColumnSpec("sequence", sequence_text, "residue letters", "designed sequence"),
    ColumnSpec("net_charge_reported", finite_float, "finite number", "charge as reported"),
))
TEST_SET = TableSpec("test_set", (
    ColumnSpec("pdb_id", entry_id, "entry id", "structure"),
    ColumnSpec("chains", chain_list, "chain list", "the two chains of the complex"),
    ColumnSpec("mmseqs_cluster_id", identifier, "text", "sequence cluster"),
    ColumnSpec("split", split_name, "train or test", "split"),
))


def describe(spark, *specs: TableSpec) -> DataFrame:
    rows = [(s.name, i, c.name, c.kind, c.doc) for s in specs for i, c in enumerate(s.columns)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, kind string, doc string")


def parse_table(raw: DataFrame, spec: TableSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed columns plus `errors`, an array of (place, column_name, problem) for the row. What a
    strict scan says about a whole row (`row_problem`) comes first, as column "(row)"."""
    cells = [(i, c.name, c.parse(F.col(c.name))) for i, c in enumerate(spec.columns)]
    found = [
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("column_name"), cell.problem.alias("problem")) for i, name, cell in cells
    ]
    if "row_problem" in raw.columns:
        found.insert(0, F.struct(F.lit(-1).alias("place"), F.lit("(row)").alias("column_name"), F.col("row_problem").alias("problem")))
    errors = F.filter(F.array(*found), lambda e: e["problem"].isNotNull())
    return raw.select(*keep, *[cell.value.alias(name) for _, name, cell in cells], errors.alias("errors"))


def error_rows(parsed: DataFrame, line: str) -> DataFrame:
    """A row per problem. With a plain explode Spark would test for empty arrays first, by parsing every
    cell a second time."""
    each = parsed.select(line, F.explode_outer("errors").alias("e")).where(F.col("e").isNotNull())
    return each.select(line, "e.place", "e.column_name", "e.problem")


def error_report(parsed: DataFrame, line: str, show: int = 40) -> DataFrame:
    """The first `show` problems in line order, each with the total count of problems."""
    errors = session.keep(error_rows(parsed, line))
    total = errors.agg(F.count(F.lit(1)).alias("n_problems"))
    return beside(errors.orderBy(line, "place").limit(show), total)


def raise_on_errors(parsed: DataFrame, line: str, show: int = 40) -> DataFrame:
    rows = error_report(parsed, line, show).collect()  # at most `show` rows
    if rows:
        text = "\n  ".join(f"line {r[line]}: {r['column_name']}: {r['problem']}" for r in rows)
        raise ValueError(f"{rows[0]['n_problems']} problem(s):\n  {text}")
    return parsed.drop("errors")


# ---- table rules -------------------------------------------------------------------------------

def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def chain_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.arrays_overlap(a, b)).withColumn("shared", F.array_join(F.array_sort(F.array_intersect(a, b)), ","))


def varying_length(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(F.length(seq)).alias("n_lengths")).where("n_lengths > 1")


def leaking_clusters(df: DataFrame, cluster: str, split: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def stray_chains(designs: DataFrame, test_set: DataFrame, key: str, named: Column, listed: str) -> DataFrame:
    """Named chains the other table does not list, distinct; unknown keys are another rule's."""
    known = test_set.select(key, listed)
    joined = designs.select(key, named.alias("_named")).distinct().join(known, key)
    stray = F.array_sort(F.array_except("_named", listed))
    return joined.select(key, F.array_join(stray, ",").alias("stray")).where(F.col("stray") != "").distinct()


def index_problems(df: DataFrame, key: str, n: Column, interface: Column, core: Column) -> DataFrame:
    out = lambda a: F.exists(a, lambda i: (i < 0) | (i >= n))
    problem = F.when(out(interface) | out(core), "index outside the sequence").when(F.arrays_overlap(interface, core), "regions overlap")
    return df.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def length_mismatch(df: DataFrame, key: str, seq: str, native: str) -> DataFrame:
    return df.where(F.length(seq) != F.length(native)).select(key, F.length(seq).alias("n"), F.length(native).alias("native_n"))


def one_value_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """De-duplicated (keys, value) with a flag where a key carried different values."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), (F.count_distinct(value) > 1).alias("conflict"))


def first_of_each(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Ordered de-duplication: each key with the line it first appeared on."""
    return df.groupBy(*keys).agg(F.min(line).alias(line))
