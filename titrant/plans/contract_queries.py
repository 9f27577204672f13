"""Cell, row and table contracts."""

from pyspark.sql import functions as F

from titrant.operators import validation as C
from titrant.operators.joins import measured
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.view_sql import sql

PH = "('','na','n/a','nan','none','null','-')"
TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def t(c):
    return TRIM.format(c=c)


def cells(spark, sf, column, parse, out=None):
    raw = V.raw_designs(spark, sf)
    cell = parse(F.col(column))
    value = cell.value if out is None else out(cell.value)
    return raw.select("row_id", value.alias("value"), cell.problem.alias("problem"))


BASE = {
    "pdb_id": f"CASE WHEN lower({t('pdb_id')}) IN {PH} THEN 'empty or placeholder' WHEN NOT regexp_full_match({t('pdb_id')}, '[0-9][A-Za-z0-9]{{3}}') THEN 'not an entry id' END",
    "beta": f"CASE WHEN lower({t('beta')}) IN {PH} THEN 'empty or placeholder' WHEN lower({t('beta')}) IN ('inf','-inf','+inf','infinity') THEN 'not finite' WHEN TRY_CAST({t('beta')} AS DOUBLE) IS NULL THEN 'not a number' END",
    "replicate": f"CASE WHEN lower({t('replicate')}) IN {PH} THEN 'empty or placeholder' WHEN NOT regexp_full_match({t('replicate')}, '[+-]?[0-9]+') THEN 'not an integer' WHEN TRY_CAST(replace({t('replicate')},'+','') AS BIGINT) < 0 THEN 'below 0' END",
    "sequence": f"CASE WHEN lower({t('sequence')}) IN {PH} THEN 'empty or placeholder' WHEN NOT regexp_full_match(upper(replace({t('sequence')},' ','')), '[ACDEFGHIKLMNPQRSTVWY]*') THEN 'letter outside the alphabet' END",
    "net_charge_reported": f"CASE WHEN lower({t('net_charge_reported')}) IN {PH} THEN 'empty or placeholder' WHEN TRY_CAST({t('net_charge_reported')} AS DOUBLE) IS NULL THEN 'not a number' END",
}


def chain_problem(c):
    parts = f"list_transform(string_split({t(c)}, ','), lambda p: trim(p))"
    return f"""CASE WHEN lower({t(c)}) IN {PH} THEN 'empty or placeholder' WHEN list_contains({parts}, '') THEN 'empty chain id'
      WHEN len(list_filter({parts}, lambda p: NOT regexp_full_match(p, '[A-Za-z0-9]{{1,4}}'))) > 0 THEN 'not a chain id' WHEN len(list_distinct({parts})) < len({parts}) THEN 'repeated chain id' END"""


BASE["designed_chain"], BASE["fixed_chain"] = chain_problem("designed_chain"), chain_problem("fixed_chain")


def cell_sql(column, value):
    return sql("raw_designs", f"SELECT row_id, CASE WHEN problem IS NULL THEN {value} END AS value, problem FROM (SELECT *, {BASE[column]} AS problem FROM raw_designs)")


@query("V01_placeholders", sql("raw_designs", f"""SELECT row_id, lower({t('pdb_id')}) IN {PH} AS pdb_id, lower({t('beta')}) IN {PH} AS beta, lower({t('sequence')}) IN {PH} AS sequence, lower({t('net_charge_reported')}) IN {PH} AS charge FROM raw_designs"""))
def v01(spark, sf):
    names = {"pdb_id": "pdb_id", "beta": "beta", "sequence": "sequence", "net_charge_reported": "charge"}
    return V.raw_designs(spark, sf).select("row_id", *[C.is_placeholder(F.col(c)).alias(a) for c, a in names.items()])


@query("V02_entry_id", cell_sql("pdb_id", f"upper({t('pdb_id')})"))
def v02(spark, sf):
    return cells(spark, sf, "pdb_id", C.entry_id)


@query("V03_chain_list", cell_sql("designed_chain", f"array_to_string(list_transform(string_split({t('designed_chain')}, ','), lambda p: trim(p)), '|')"))
def v03(spark, sf):
    return cells(spark, sf, "designed_chain", C.chain_list, lambda v: F.array_join(v, "|"))


@query("V04_finite_float", cell_sql("beta", f"TRY_CAST({t('beta')} AS DOUBLE)"))
def v04(spark, sf):
    return cells(spark, sf, "beta", C.finite_float)


@query("V05_strict_integer", cell_sql("replicate", f"TRY_CAST(replace({t('replicate')},'+','') AS BIGINT)"))
def v05(spark, sf):
    return cells(spark, sf, "replicate", C.strict_int(0))


@query("V06_sequence_alphabet", cell_sql("sequence", f"upper(replace({t('sequence')},' ',''))"))
def v06(spark, sf):
    return cells(spark, sf, "sequence", C.sequence_text)


@query("V07_split_and_identifier", """
    SELECT c_custkey AS row_id, CASE WHEN c_nationkey < 10 THEN 'train' WHEN c_nationkey < 20 THEN 'test' END AS split, CASE WHEN c_nationkey >= 20 THEN 'not train or test' END AS split_problem,
      c_name AS identifier FROM customer""")
def v07(spark, sf):
    n = F.col("c_nationkey")
    c = V.table(spark, sf, "customer").withColumn("raw", F.when(n < 10, " Train").when(n < 20, "TEST ").otherwise("validation"))
    s, i = C.split_name(F.col("raw")), C.identifier(F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")))
    return c.select(F.col("c_custkey").alias("row_id"), s.value.alias("split"), s.problem.alias("split_problem"), i.value.alias("identifier"))


ORDER = ["pdb_id", "designed_chain", "fixed_chain", "beta", "replicate", "sequence", "net_charge_reported"]
ERRORS_SQL = "errors AS (" + " UNION ALL ".join(
    f"SELECT row_id + 2 AS line, {i} AS place, '{c}' AS column_name, {BASE[c]} AS problem FROM raw_designs" for i, c in enumerate(ORDER)) + ")"


def parsed(spark, sf):
    raw = V.raw_designs(spark, sf).withColumn("line", F.col("row_id") + 2)
    return C.parse_table(raw, C.DESIGNS, keep=["line"])


@query("V08_all_errors", sql("raw_designs", f"""WITH {ERRORS_SQL} SELECT line, place, column_name, problem, (SELECT count(*) FROM errors WHERE problem IS NOT NULL) AS n_problems
    FROM errors WHERE problem IS NOT NULL ORDER BY line, place LIMIT 40"""))
def v08(spark, sf):
    return C.error_report(parsed(spark, sf), "line", 40)


@query("X02_pluggable_parsers", sql("raw_designs", f"""WITH {ERRORS_SQL} SELECT column_name, problem, count(*) AS n, min(line) AS first_line FROM errors WHERE problem IS NOT NULL GROUP BY ALL"""))
def x02(spark, sf):
    return C.error_rows(parsed(spark, sf), "line").groupBy("column_name", "problem").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


@query("W10_first_examples", sql("raw_designs", f"""WITH {ERRORS_SQL} SELECT line, column_name, problem FROM errors WHERE problem IS NOT NULL ORDER BY line, place LIMIT 25"""))
def w10(spark, sf):
    return C.error_rows(parsed(spark, sf), "line").orderBy("line", "place").limit(25).select("line", "column_name", "problem")


@query("V09_repeated_keys", sql("designs", "SELECT pdb_id, designed, beta, replicate::BIGINT AS replicate, count(*) AS n_rows FROM designs GROUP BY ALL HAVING count(*) > 1"))
def v09(spark, sf):
    d = V.designs(spark, sf).withColumn("designed", F.array_join("designed_chain", ","))
    return C.repeated_keys(d, ["pdb_id", "designed", "beta", "replicate"])


@query("V10_chain_overlap", sql("designs", "SELECT row_id, designed AS shared FROM designs WHERE designed = fixed"))
def v10(spark, sf):
    return C.chain_overlap(V.designs(spark, sf), "designed_chain", "fixed_chain").select("row_id", "shared")


@query("V11_constant_length", sql("designs", "SELECT pdb_id, designed, count(DISTINCT length(sequence)) AS n_lengths FROM designs GROUP BY ALL HAVING count(DISTINCT length(sequence)) > 1"))
def v11(spark, sf):
    d = V.designs(spark, sf).withColumn("designed", F.array_join("designed_chain", ","))
    return C.varying_length(d, ["pdb_id", "designed"], "sequence")


@query("V12_unique_id_and_arity", sql("raw_test_set", """
    SELECT pdb_id, count(*) AS n_rows, count(*) FILTER (WHERE len(chains) <> 2) AS n_wrong_arity FROM raw_test_set GROUP BY pdb_id HAVING count(*) > 1 OR count(*) FILTER (WHERE len(chains) <> 2) > 0"""))
def v12(spark, sf):
    s = V.raw_test_set(spark, sf).groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("chains") != 2).alias("n_wrong_arity"))
    return s.where("n_rows > 1 OR n_wrong_arity > 0")


@query("V13_split_leakage", sql("raw_test_set", "SELECT cluster, count(DISTINCT split) AS n_splits FROM raw_test_set GROUP BY cluster HAVING count(DISTINCT split) > 1"))
def v13(spark, sf):
    return C.leaking_clusters(V.raw_test_set(spark, sf), "cluster", "split")


@query("V14_unknown_entries", sql("designs raw_test_set", "SELECT pdb_id, count(*) AS n_rows FROM designs WHERE pdb_id NOT IN (SELECT pdb_id FROM raw_test_set) GROUP BY pdb_id"))
def v14(spark, sf):
    d = V.designs(spark, sf).groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return d.join(V.raw_test_set(spark, sf), "pdb_id", "left_anti")


@query("V15_stray_chains", sql("designs raw_test_set", """
    WITH n AS (SELECT DISTINCT pdb_id, list_sort(list_distinct([designed, fixed])) AS named FROM designs), s AS (SELECT n.pdb_id, array_to_string(list_filter(named, lambda c: NOT list_contains(chains, c)), ',') AS stray FROM n JOIN raw_test_set t USING (pdb_id))
    SELECT DISTINCT pdb_id, stray FROM s WHERE stray <> ''"""))
def v15(spark, sf):
    return C.stray_chains(V.designs(spark, sf), V.raw_test_set(spark, sf), "pdb_id", F.array_union("designed_chain", "fixed_chain"), "chains")


@query("V17_index_bounds", sql("seqs", """
    WITH i AS (SELECT doc_id, length(seq) AS n, doc_id % 7 - 1 AS a, doc_id % 2000 AS b, doc_id % 5 AS c FROM seqs)
    SELECT doc_id, CASE WHEN a<0 OR a>=n OR b>=n OR c>=n THEN 'index outside the sequence' ELSE 'regions overlap' END AS problem FROM i WHERE a<0 OR a>=n OR b>=n OR c>=n OR a=c OR b=c"""))
def v17(spark, sf):
    d = F.col("doc_id")
    return C.index_problems(V.seqs(spark, sf), "doc_id", F.length("seq"), F.array(d % 7 - 1, d % 2000), F.array(d % 5))


@query("V20_length_against_native", sql("seqs natives", """
    SELECT doc_id, length(seq)::BIGINT AS n, length(native_seq)::BIGINT AS native_n FROM seqs JOIN natives USING (source, lang) WHERE length(seq) <> length(native_seq)"""))
def v20(spark, sf):
    s = V.seqs(spark, sf)
    return C.length_mismatch(s.join(measured(V.natives(s)), ["source", "lang"]), "doc_id", "seq", "native_seq")


@query("V21_conflicting_values", """
    SELECT o_custkey AS entry, o_orderstatus AS chain, min(o_orderpriority) AS value, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY ALL""")
def v21(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("entry"), F.col("o_orderstatus").alias("chain"), F.col("o_orderpriority").alias("value"))
    return C.one_value_per_key(o, ["entry", "chain"], "value")


@query("U05_ordered_dedup", "SELECT user_id, event_type, min(event_id) AS line FROM events GROUP BY ALL")
def u05(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("line"))
    return C.first_of_each(e, ["user_id", "event_type"], "line")


@query("S03_describe_contract", sql("raw_designs", """
    SELECT d.column_name, d.place, kind, n_filled FROM (VALUES ('pdb_id',0,'entry id'),('designed_chain',1,'chain list'),('fixed_chain',2,'chain list'),('beta',3,'finite number'),('replicate',4,'integer, 0 or more'),('sequence',5,'residue letters'),('net_charge_reported',6,'finite number')) d(column_name, place, kind)
    JOIN (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} <> '') AS n_filled FROM raw_designs" for c in ORDER) + ") f USING (column_name)"))
def s03(spark, sf):
    from titrant.operators.pairing import fill_rates

    raw = V.raw_designs(spark, sf).select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in ORDER])
    filled = fill_rates(raw, ORDER).select(F.col("column").alias("column_name"), F.col("filled").alias("n_filled"))
    return C.describe(spark, C.DESIGNS).join(filled, "column_name").select("column_name", "place", "kind", "n_filled")
