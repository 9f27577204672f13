"""Structure files, chains and superposition."""

from pyspark.sql import functions as F

from titrant.operators import spatial as S, superpose as SP
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.view_sql import sql
from titrant.session import new_folder
from titrant.sources import files, structures as ST


def rendered(spark, sf, shift=0.0):
    p = V.polymer(spark, sf).withColumn("x", F.col("x") + shift)
    return p.select("structure", "serial", ST.render(p).alias("value"))


def file_lines(spark, sf):
    """Two models per structure: the coordinates, and the same moved by one along x."""
    one, two = rendered(spark, sf), rendered(spark, sf, 1.0)
    marks = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(v).alias("value")) for o, v in ((0, "MODEL        1"), (5000, "ENDMDL"), (6000, "MODEL        2"), (20000, "ENDMDL"))])
    heads = one.select("structure").distinct().select("structure", F.explode(marks).alias("m")).select("structure", "m.ord", "m.value")
    body = one.select("structure", F.col("serial").alias("ord"), "value").unionByName(two.select("structure", (F.col("serial") + 10000).alias("ord"), "value"))
    return heads.unionByName(body)


def write_structures(lines, label):
    """One file per structure, in a folder named after it."""
    path = new_folder(lines.sparkSession, label)
    lines.repartition("structure").sortWithinPartitions("structure", "ord").select("value", "structure").write.partitionBy("structure").text(path)
    return path


def folder_name(path):
    return F.regexp_extract(path, "structure=([0-9]+)", 1)


@query("S08_atom_scan", sql("polymer", "SELECT structure, record, serial, atom, altloc, resname, chain, seqid, x + 1 AS x, y, z, element FROM (SELECT *, round(x,3) AS xx FROM polymer)").replace("x + 1 AS x", "round(x + 1, 3) AS x"))
def s08(spark, sf):
    from titrant.params import AtomParams

    a = ST.read_atoms(spark, write_structures(file_lines(spark, sf), "structures"), AtomParams(model_index=1))
    return a.select(folder_name(F.col("file")).cast("bigint").alias("structure"), "record", "serial", "atom", "altloc", "resname", "chain", "seqid", "x", "y", "z", "element")


@query("S09_coordinate_lines", sql("polymer", "SELECT structure, count(*) AS n, sum(length(value))::BIGINT AS n_chars FROM file_lines WHERE value LIKE 'ATOM%' OR value LIKE 'HETATM%' GROUP BY structure"))
def s09(spark, sf):
    lines = file_lines(spark, sf).withColumn("value", F.concat("value", F.lit("   ")))
    c = files.coordinate_lines(spark, write_structures(lines, "padded"))
    return c.groupBy(folder_name(F.col("file")).cast("bigint").alias("structure")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("S10_file_digests", sql("polymer", "SELECT structure::VARCHAR AS path, sha256, bytes FROM file_digest"))
def s10(spark, sf):
    return files.digests(spark, write_structures(file_lines(spark, sf), "structures"), folder_name(F.col("path")))


@query("S11_file_index", sql("polymer", "SELECT structure::VARCHAR AS stem, 1::BIGINT AS n_files FROM file_digest"))
def s11(spark, sf):
    path = write_structures(file_lines(spark, sf), "structures")
    return files.index(spark, path, ("txt",), folder_name(F.col("path"))).select("stem", "n_files")


def changed_lines(spark, sf):
    """A second delivery: a third equal, a third with an extra remark, a third moved."""
    f = file_lines(spark, sf)
    s = F.col("structure") % 3
    moved = f.withColumn("value", F.when((s == 2) & F.col("value").startswith("ATOM"), F.replace("value", F.lit("  1.00"), F.lit("  0.50"))).otherwise(F.col("value")))
    remarks = f.where(s == 1).select("structure").distinct().select("structure", F.lit(-1).alias("ord"), F.lit("REMARK second delivery").alias("value"))
    return moved.unionByName(remarks)


@query("J08_compare_inventories", sql("polymer", "SELECT structure::VARCHAR AS stem, CASE structure % 3 WHEN 0 THEN 'identical' WHEN 1 THEN 'same coordinates' ELSE 'different' END AS status FROM file_digest"))
def j08(spark, sf):
    left = write_structures(file_lines(spark, sf), "structures")
    right = write_structures(changed_lines(spark, sf), "second")
    return files.compare(spark, left, right, folder_name)


@query("S18_drift_report", sql("polymer", "SELECT structure::VARCHAR AS path, bytes, CASE structure % 3 WHEN 0 THEN 'ok' ELSE 'changed' END AS status FROM file_digest"))
def s18(spark, sf):
    recorded = files.digests(spark, write_structures(file_lines(spark, sf), "structures"), folder_name(F.col("path")))
    now = files.digests(spark, write_structures(changed_lines(spark, sf), "second"), folder_name(F.col("path")))
    return files.drift(recorded, now).select("path", "bytes", "status")


@query("S17_run_record", sql("polymer", """
    WITH e AS (SELECT bytes, sha256(structure||'|'||bytes||'|'||sha256) AS h FROM file_digest),
    r AS (SELECT '{"inputs":{"bytes":'||sum(bytes)::BIGINT||',"digest":"'||concat_ws('-', """ + ", ".join(
    f"bit_xor(('0x'||substr(h,{at},15))::BIGINT)" for at in (1, 16, 31, 46)) + """)||'","files":'||count(*)||'},"parameters":{"cutoff":5.0,"probe":1.4},"seeds":{"seed":0}}' AS record FROM e)
    SELECT sha256(record) AS run_hash, length(record)::BIGINT AS n_chars FROM r"""))
def s17(spark, sf):
    inputs = files.digests(spark, write_structures(file_lines(spark, sf), "structures"), folder_name(F.col("path")))
    out = files.run_record(inputs, {"cutoff": 5.0, "probe": 1.4}, {"seed": 0})
    return out.select("run_hash", F.length("record").cast("bigint").alias("n_chars"))


def extracted(spark, sf):
    return ST.extract_chains(V.polymer(spark, sf), "structure", "serial")


@query("P01_extract_chains", sql("polymer", "SELECT structure, chain, seqid, resname, aa, pos, skipped, problem FROM extracted"))
def p01(spark, sf):
    return extracted(spark, sf).select("structure", "chain", "seqid", "resname", "aa", "pos", "skipped", "problem")


@query("P02_chain_audit", sql("polymer", """
    SELECT structure, chain, count(aa) AS n_residues, count(*) FILTER (WHERE modified) AS n_substituted, count(*) FILTER (WHERE skipped) AS n_skipped, count(problem) AS n_problems,
      coalesce(string_agg(resname||'>'||aa, ',' ORDER BY first_serial) FILTER (WHERE modified), '') AS substitutions FROM extracted GROUP BY ALL"""))
def p02(spark, sf):
    return ST.chain_audit(extracted(spark, sf), "structure")


@query("P03_heavy_atoms", sql("atoms", "SELECT structure, chain, pos, count(*) AS n, string_agg(atom, ',' ORDER BY atom) AS names FROM heavy GROUP BY ALL"))
def p03(spark, sf):
    h = S.heavy(V.atoms(spark, sf))
    return h.groupBy("structure", "chain", "pos").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("atom")), ",").alias("names"))


@query("P04_submodel", sql("polymer", "SELECT structure, seqid, atom, altloc, resname FROM polymer WHERE chain='A' AND element<>'H' AND (record='ATOM' OR resname IN ('MSE','SEP'))"))
def p04(spark, sf):
    return S.submodel(V.polymer(spark, sf), ["A"]).select("structure", "seqid", "atom", "altloc", "resname")


@query("P05_chains_present", sql("polymer", "SELECT structure, chain, min(serial) AS first_line, count(*) AS n_atoms FROM polymer GROUP BY ALL"))
def p05(spark, sf):
    return ST.chains_present(V.polymer(spark, sf), "structure", "serial")


@query("P06_positions_of_ids", sql("polymer", """
    SELECT i.structure, i.chain, i.seqid, e.pos, CASE WHEN e.pos IS NULL THEN 'unknown residue id' END AS problem FROM (SELECT DISTINCT structure, chain, seqid FROM polymer) i
    LEFT JOIN (SELECT * FROM extracted WHERE pos IS NOT NULL) e ON i.structure=e.structure AND i.chain=e.chain AND i.seqid=e.seqid"""))
def p06(spark, sf):
    p = V.polymer(spark, sf)
    ids = p.select("structure", "chain", "seqid", "icode").distinct()
    return ST.positions_of(ids, extracted(spark, sf), "structure").select("structure", "chain", "seqid", "pos", "problem")


def native_and_predicted(spark, sf):
    """The predicted side is the native one turned about z, moved, and jittered on the designed chain."""
    from titrant.operators.surface import letters

    native = V.atoms(spark, sf).where(F.col("altloc").isin("", "A")).withColumn("aa", letters(F.col("resname")))
    jitter = F.when(F.col("chain") == "A", (F.col("vec_id") % 7) * 0.05).otherwise(0.0)
    predicted = native.withColumn("_x", F.col("x")).withColumn("x", -F.col("y") + 5.0).withColumn("y", F.col("_x") - 3.0).withColumn(
        "z", F.col("z") + 1.0 + jitter).drop("_x")
    predicted = predicted.withColumn("aa", F.when(F.col("vec_id") % 13 == 0, "P").otherwise(F.col("aa")))
    return native, predicted


def residue_letters(a):
    return a.select("structure", "chain", "pos", "aa").distinct()


@query("J19_residue_pairs", sql("atoms", "SELECT DISTINCT structure, chain, pos FROM atoms WHERE vec_id % 13 <> 0"))
def j19(spark, sf):
    n, p = native_and_predicted(spark, sf)
    return SP.pair_residues(residue_letters(n), residue_letters(p)).select("structure", "chain", "pos")


@query("A50_interface_rmsd", sql("atoms", """
    WITH k AS (SELECT structure, chain, pos, any_value(vec_id) AS v FROM atoms WHERE vec_id % 13 <> 0 GROUP BY ALL), n AS (SELECT structure, count(*) FILTER (WHERE chain='B') AS nb, count(*) FILTER (WHERE chain='A') AS na,
      sqrt(avg(((v % 7)*0.05)*((v % 7)*0.05)) FILTER (WHERE chain='A')) AS r FROM k GROUP BY structure)
    SELECT structure, CASE WHEN nb >= 10 AND na > 0 THEN round(r,6) END AS interface_rmsd, CASE WHEN nb >= 10 AND na > 0 THEN na END AS n_compared, CASE WHEN nb >= 10 THEN 0.0::DOUBLE END AS superposition_rmsd,
      CASE WHEN nb < 10 THEN 'too few partner residues paired' WHEN na = 0 THEN 'no interface residue paired' END AS note FROM n"""))
def a50(spark, sf):
    # The jitter is along one axis and the partner chain fits exactly, so the deviation is known.
    n, p = native_and_predicted(spark, sf)
    pairs = SP.pair_residues(residue_letters(n), residue_letters(p))
    inside = n.where("chain = 'A'").select("structure", "chain", "pos").distinct()
    out = SP.interface_rmsd(n, p, pairs, inside, "A", "B")
    return out.withColumn("interface_rmsd", F.round("interface_rmsd", 6)).withColumn("superposition_rmsd", F.round("superposition_rmsd", 4) + F.lit(0.0))
