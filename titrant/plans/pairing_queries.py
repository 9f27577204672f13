"""Dose grids compared with their own reference."""

from pyspark.sql import functions as F

from titrant.functions.hydropathy import place_on_diagram
from titrant.operators import pairing as P
from titrant.operators.ordering import medians, quantiles
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.sequence_queries import DIAGRAM_SQL, r6
from titrant.plans.view_sql import sql

KEYS = V.LINEAGE
DELTA_SQL = """deltas AS (SELECT g.*, g.score - r.score AS delta_score, g.conf - r.conf AS delta_conf,
    r.score IS NOT NULL OR r.conf IS NOT NULL AS has_reference FROM grid g LEFT JOIN (SELECT * FROM grid WHERE beta = 0) r USING (part, flag))"""
CHANGE_SQL = """change AS (SELECT g.part, g.flag, g.beta, g.score, r.score AS reference, g.score - r.score AS delta
    FROM grid g JOIN (SELECT * FROM grid WHERE beta = 0 AND score IS NOT NULL) r USING (part, flag) WHERE g.beta <> 0 AND g.score IS NOT NULL)"""


@query("J03_reference_join", sql("grid", f"WITH {DELTA_SQL} SELECT part, flag, beta, delta_score, has_reference FROM deltas"))
def j03(spark, sf):
    return P.paired_deltas(V.grid(spark, sf), KEYS, ["score"]).select("part", "flag", "beta", "delta_score", "has_reference")


@query("A20_delta_columns", sql("grid", f"WITH {DELTA_SQL} SELECT part, flag, beta, delta_score, delta_conf, has_reference FROM deltas"))
def a20(spark, sf):
    return P.paired_deltas(V.grid(spark, sf), KEYS, ["score", "conf"]).select(
        "part", "flag", "beta", "delta_score", "delta_conf", "has_reference")


@query("W02_reference_in_lineage", sql("grid", """
    SELECT part, flag, beta, max(CASE WHEN beta = 0 THEN score END) OVER (PARTITION BY part, flag) AS reference_score FROM grid"""))
def w02(spark, sf):
    # Aggregate and join: the same value a window would broadcast, without sorting a lineage.
    g = V.grid(spark, sf)
    one = g.groupBy(*KEYS).agg(F.max(F.when(F.col("beta") == 0, F.col("score"))).alias("reference_score"))
    return g.join(one, list(KEYS)).select("part", "flag", "beta", "reference_score")


@query("J04_inner_reference_join", sql("grid", f"WITH {CHANGE_SQL} SELECT * FROM change"))
def j04(spark, sf):
    return P.paired_change(V.grid(spark, sf), KEYS, "score")


@query("V18_required_columns", "SELECT 'grid' AS table_name, 0::BIGINT AS n_missing, count(*) AS n_rows FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linenumber FROM lineitem)")
def v18(spark, sf):
    g = V.grid(spark, sf)
    P.require_columns(g, [*KEYS, "beta", "score"], "grid")
    return g.agg(F.lit("grid").alias("table_name"), F.lit(0).cast("bigint").alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))


@query("V19_reference_unique", """
    SELECT l_suppkey AS complex, l_returnflag AS flag, count(*) AS n_reference FROM lineitem WHERE l_linenumber = 1
    GROUP BY ALL HAVING count(*) > 1""")
def v19(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("complex"), F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") - 1).cast("double").alias("beta"))
    return P.duplicated_references(raw, ["complex", "flag"], "beta")


PANEL_SQL = """per AS (SELECT part, flag, count(*) AS rows, count(DISTINCT beta) = (SELECT count(DISTINCT beta) FROM grid) AS complete FROM grid GROUP BY ALL)"""


@query("A18_balanced_panel", sql("grid", f"WITH {PANEL_SQL} SELECT part, flag, beta, score FROM grid JOIN per USING (part, flag) WHERE complete"))
def a18(spark, sf):
    return P.balanced_panel(V.grid(spark, sf), KEYS).select("part", "flag", "beta", "score")


@query("A19_pairing_report", sql("grid", f"""WITH {PANEL_SQL}
    SELECT NULL::DOUBLE AS beta, sum(rows)::BIGINT AS n_rows, count(*) AS n_lineages, count(*) FILTER (WHERE complete) AS n_lineages_complete,
      coalesce(sum(rows) FILTER (WHERE complete), 0)::BIGINT AS n_rows_balanced FROM per
    UNION ALL SELECT beta, count(*), NULL, NULL, NULL FROM grid GROUP BY beta"""))
def a19(spark, sf):
    return P.pairing_report(V.grid(spark, sf), KEYS)


@query("A21_return_rate", sql("grid", """
    SELECT beta, n_returned, rate, (max(rate) OVER () - rate) > 0.15 AS depleted FROM (
      SELECT beta, count(*) AS n_returned, count(*) / (SELECT count(*) FROM (SELECT DISTINCT part, flag FROM grid)) AS rate FROM grid GROUP BY beta)"""))
def a21(spark, sf):
    g = V.grid(spark, sf)
    return P.completeness(g, g.select(*KEYS).distinct().count())


@query("A23_retained_subset", sql("grid", """
    SELECT g.part, g.flag, g.beta, g.conf FROM grid g LEFT JOIN (SELECT * FROM grid WHERE beta = 0 AND conf IS NOT NULL) r USING (part, flag)
    WHERE r.conf IS NULL OR r.conf - g.conf <= 10"""))
def a23(spark, sf):
    return P.retained(V.grid(spark, sf), KEYS, "conf", 10.0).select("part", "flag", "beta", "conf")


@query("A24_absolute_floor", sql("grid", """
    SELECT beta, count(*) AS n, round(quantile_cont(conf, 0.5),6)+0.0 AS median, min(conf) AS lowest, max(conf) AS highest,
      count(*) FILTER (WHERE conf >= 30) AS n_at_or_above_floor FROM grid GROUP BY beta"""))
def a24(spark, sf):
    g = V.grid(spark, sf)
    stats = g.groupBy("beta").agg(
        F.count("conf").alias("n"), F.min("conf").alias("lowest"), F.max("conf").alias("highest"),
        F.count_if(F.col("conf") >= 30).alias("n_at_or_above_floor"))
    middle = quantiles(g, ["beta"], "conf", {"median": 0.5}).withColumn("median", r6(F.col("median")))
    return stats.join(middle, "beta")


@query("A25_mixed_backends", sql("jobs", """
    SELECT complex, beta, count(DISTINCT coalesce(device,'unrecorded')) AS n_devices,
      string_agg(DISTINCT coalesce(device,'unrecorded'), ',' ORDER BY coalesce(device,'unrecorded')) AS devices
    FROM jobs GROUP BY ALL HAVING count(DISTINCT coalesce(device,'unrecorded')) > 1"""))
def a25(spark, sf):
    return P.mixed_backends(V.jobs(spark, sf), ["complex", "beta"], "device")


@query("A44_median_by_dose", sql("grid", """
    SELECT beta, 'score' AS name, round(quantile_cont(score,0.5),4)+0.0 AS median FROM grid GROUP BY beta
    UNION ALL SELECT beta, 'conf', round(quantile_cont(conf,0.5),4)+0.0 FROM grid GROUP BY beta"""))
def a44(spark, sf):
    m = medians(V.grid(spark, sf), ["beta"], ["score", "conf"])
    return m.withColumn("median", F.round("median", 4) + F.lit(0.0))


@query("A45_fill_and_coverage", sql("jobs", """
    SELECT 'filled' AS what, 'device' AS item, count(device) AS n FROM jobs UNION ALL SELECT 'filled','k', count(k) FROM jobs
    UNION ALL SELECT 'filled','wall', count(wall) FROM jobs
    UNION ALL SELECT 'complexes with doses', d::VARCHAR, count(*) FROM (SELECT complex, count(DISTINCT beta) AS d FROM jobs GROUP BY complex) GROUP BY d"""))
def a45(spark, sf):
    j = V.jobs(spark, sf)
    fill = P.fill_rates(j, ["device", "k", "wall"]).select(F.lit("filled").alias("what"), F.col("column").alias("item"), F.col("filled").alias("n"))
    cover = P.coverage(j, "complex", "beta").select(
        F.lit("complexes with doses").alias("what"), F.col("n_doses").cast("string").alias("item"), F.col("n_complexes").alias("n"))
    return fill.unionByName(cover)


@query("J01_entry_lookup", """
    SELECT o_orderkey, c_mktsegment AS cluster, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey""")
def j01(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("cluster"), F.col("c_nationkey").alias("nation"))
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "cluster", "nation")


@query("J02_definition_lookup", """
    SELECT l.l_partkey AS part, l.l_suppkey AS supplier, p.p_brand AS brand, CASE WHEN p.p_partkey IS NULL THEN 'no definition' END AS error, count(*) AS n
    FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l.l_partkey = p.p_partkey GROUP BY ALL""")
def j02(spark, sf):
    # Definitions exist for some entries only; a miss becomes an error row, never a lost one.
    defs = V.table(spark, sf, "part").where("p_size > 10").select("p_partkey", F.col("p_brand").alias("brand"))
    li = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("n"))
    out = li.join(defs, li.part == defs.p_partkey, "left")
    return out.select("part", "supplier", "brand", F.when(F.col("p_partkey").isNull(), "no definition").alias("error"), "n")


@query("J05_fold_join", sql("residues aa_dim folded", f"""WITH {DIAGRAM_SQL}
    SELECT d.doc_id, d.beta, predicted_disordered, folded, round(rmsd,6)+0.0 AS rmsd FROM diagram d JOIN folded USING (doc_id)"""))
def j05(spark, sf):
    d = place_on_diagram(V.seqs(spark, sf)).select("doc_id", "beta", "predicted_disordered")
    return d.join(V.folded(spark, sf), "doc_id").withColumn("rmsd", r6(F.col("rmsd")))


@query("J06_common_ids", """
    WITH l AS (SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders), r AS (SELECT DISTINCT user_id::VARCHAR AS id FROM events)
    SELECT count(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS n_common, count(*) FILTER (WHERE r.id IS NULL) AS n_only_left,
      count(*) FILTER (WHERE l.id IS NULL) AS n_only_right FROM l FULL JOIN r ON l.id = r.id""")
def j06(spark, sf):
    left = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    right = V.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return P.common_ids(left, right, "id")


@query("J17_two_halves", """
    WITH h AS (SELECT l_suppkey AS complex, l_linenumber AS dose, l_linestatus AS chain, sum(l_quantity)::BIGINT AS charge, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT a.complex, a.dose, a.charge AS charge_f, b.charge AS charge_o, a.n AS n_f, b.n AS n_o FROM h a JOIN h b ON a.complex = b.complex AND a.dose = b.dose
    WHERE a.chain = 'F' AND b.chain = 'O'""")
def j17(spark, sf):
    h = V.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("complex"), F.col("l_linenumber").alias("dose"), F.col("l_linestatus").alias("chain")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("charge"), F.count(F.lit(1)).alias("n"))
    half = lambda c, tag: h.where(F.col("chain") == c).select("complex", "dose", F.col("charge").alias(f"charge_{tag}"), F.col("n").alias(f"n_{tag}"))
    return half("F", "f").join(half("O", "o"), ["complex", "dose"])


@query("V22_half_filled_control", sql("jobs", """
    SELECT count(*) AS n_rows, count(device) AS n_filled, CASE WHEN count(device)=0 THEN 'no_control' WHEN count(device)<count(*) THEN 'refused' ELSE 'complete' END AS status FROM jobs"""))
def v22(spark, sf):
    return P.control_status(V.jobs(spark, sf), "device", "refuse")


@query("P10_dose_and_id_filter", sql("grid", "SELECT part, flag, score FROM grid WHERE beta = 2 AND flag IN ('A','N')"))
def p10(spark, sf):
    return V.grid(spark, sf).where((F.col("beta") == 2.0) & F.col("flag").isin("A", "N")).select("part", "flag", "score")
