"""Work lists and their reports."""

from pyspark.sql import functions as F

from titrant.operators import work as K
from titrant.operators.ordering import medians, upper_median
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.view_sql import sql

REASON = "CASE WHEN kind='purchase' THEN 'done' WHEN residues < 200 THEN 'too small' WHEN residues > 1000 THEN 'too large' WHEN beta NOT IN (-3, 0, 3) THEN 'dose not wanted' ELSE 'kept' END"


def reasons(spark, sf):
    return V.jobs(spark, sf).withColumn("reason", K.scope_reason(F.col("kind") == "purchase", F.col("residues"), 200, 1000, F.col("beta"), [-3.0, 0.0, 3.0]))


@query("P11_scope_filter", sql("jobs", f"SELECT key, complex, beta FROM (SELECT *, {REASON} AS reason FROM jobs) WHERE reason = 'kept'"))
def p11(spark, sf):
    return reasons(spark, sf).where("reason = 'kept'").select("key", "complex", "beta")


@query("A46_reason_counts", sql("jobs", f"SELECT {REASON} AS reason, count(*) AS n FROM jobs GROUP BY 1"))
def a46(spark, sf):
    return K.reason_counts(reasons(spark, sf), "reason")


@query("S19_resume", sql("jobs", "SELECT key, complex FROM jobs WHERE key NOT IN (SELECT key FROM jobs WHERE kind = 'purchase')"))
def s19(spark, sf):
    j = V.jobs(spark, sf)
    return K.outstanding(j, j.where("kind = 'purchase'"), "key").select("key", "complex")


@query("J07_not_returned", sql("jobs", "SELECT key FROM jobs WHERE failed"))
def j07(spark, sf):
    j = V.jobs(spark, sf)
    return j.select("key").join(j.where(~F.col("failed")).select("key"), "key", "left_anti")


@query("W03_largest_first", sql("jobs", """
    SELECT key, residues, CASE WHEN r <= 5 THEN r END AS lead_rank FROM (SELECT *, row_number() OVER (ORDER BY residues DESC, key) AS r FROM jobs)"""))
def w03(spark, sf):
    return K.largest_first(V.jobs(spark, sf), "residues", "key", 5).select("key", "residues", "lead_rank")


@query("W04_spaced_sample", sql("jobs", """
    WITH c AS (SELECT complex, max(residues) AS s FROM jobs GROUP BY complex), r AS (SELECT complex, row_number() OVER (ORDER BY s, complex) - 1 AS pos, count(*) OVER () AS n FROM c),
    want AS (SELECT round_even(i*(n-1)/3.0::DOUBLE, 0)::BIGINT AS pos FROM (SELECT max(n) AS n FROM r), range(4) t(i)),
    p AS (SELECT complex FROM r WHERE pos IN (SELECT pos FROM want) OR pos = n-1)
    SELECT complex, key, beta FROM (SELECT j.*, row_number() OVER (PARTITION BY complex ORDER BY abs(beta), beta, key) AS place FROM jobs j JOIN p USING (complex)) WHERE place <= 2"""))
def w04(spark, sf):
    return K.spaced_sample(V.jobs(spark, sf), "complex", "residues", "beta", "key", 4, 2).select("complex", "key", "beta")


RUN_SQL = """runs AS (SELECT j.complex, count(*) AS n, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE l.last IS NULL OR key > l.last) AS trailing
    FROM jobs j JOIN (SELECT complex, max(key) FILTER (WHERE NOT failed) AS last FROM jobs GROUP BY complex) l USING (complex) GROUP BY j.complex)"""


@query("W05_trailing_failures", sql("jobs", f"WITH {RUN_SQL} SELECT * FROM runs"))
def w05(spark, sf):
    return K.trailing_failures(V.jobs(spark, sf), ["complex"], "key", "failed")


@query("W06_stop_verdict", sql("jobs", f"""WITH {RUN_SQL} SELECT complex, CASE WHEN runs."trailing" >= 2 THEN 'stop: consecutive failures' WHEN n >= 8 AND n_failed/n > 0.25 THEN 'stop: failure rate' ELSE 'continue' END AS verdict FROM runs"""))
def w06(spark, sf):
    runs = K.trailing_failures(V.jobs(spark, sf), ["complex"], "key", "failed")
    return K.stop_verdict(runs, max_run=2, max_rate=0.25).select("complex", "verdict")


@query("W07_waves", sql("jobs", "SELECT key, CASE WHEN round(beta,6) = 0 THEN 0 WHEN round(beta,6) IN (-1.5, 1.5) THEN 1 ELSE 2 END AS wave FROM jobs"))
def w07(spark, sf):
    return V.jobs(spark, sf).select("key", K.wave_of(F.col("beta"), [[0.0], [-1.5, 1.5]]).alias("wave"))


@query("W08_chunks", sql("jobs", """
    SELECT chunk, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT key, (row_number() OVER (ORDER BY complex, key) - 1) // 100 AS chunk FROM jobs) GROUP BY chunk"""))
def w08(spark, sf):
    c = K.chunks(V.jobs(spark, sf).select("complex", "key"), [F.col("complex"), F.col("key")], 100)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("W11_deterministic_tie_break", """
    SELECT user_id, event_type AS favourite, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1""")
def w11(spark, sf):
    n = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("event_type"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("favourite"), (-F.col("b.m")).alias("n"))


@query("W12_upper_median", sql("jobs", """
    SELECT beta, max(residues) FILTER (WHERE r = n // 2)::DOUBLE AS upper_median, max(residues)::DOUBLE AS max FROM (SELECT beta, residues, row_number() OVER (PARTITION BY beta ORDER BY residues) - 1 AS r, count(*) OVER (PARTITION BY beta) AS n FROM jobs) GROUP BY beta"""))
def w12(spark, sf):
    return upper_median(V.jobs(spark, sf), ["beta"], "residues")


@query("A51_wave_report", sql("jobs", """
    SELECT beta AS wave, count(*) AS n_jobs, count(*) FILTER (WHERE NOT failed) AS n_succeeded, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE NOT failed)/count(*) AS success_rate,
      round(quantile_cont(k::DOUBLE,0.5) FILTER (WHERE NOT failed),6) AS median_k, round(quantile_cont(wall,0.5) FILTER (WHERE NOT failed),6) AS median_wall,
      (SELECT string_agg(key::VARCHAR, ',' ORDER BY key) FROM (SELECT key FROM jobs f WHERE f.failed AND f.beta = jobs.beta ORDER BY key LIMIT 5)) AS first_failures FROM jobs GROUP BY beta"""))
def a51(spark, sf):
    j = V.jobs(spark, sf).withColumn("wave", F.col("beta"))
    out = K.wave_report(j, "wave", "failed", ["k", "wall"], "key", F.col("key").cast("string"))
    return out.withColumn("median_k", F.round("median_k", 6)).withColumn("median_wall", F.round("median_wall", 6))


@query("A52_first_and_repeat", sql("jobs", """
    WITH m AS (SELECT wall, row_number() OVER (PARTITION BY complex ORDER BY ts, key) = 1 AS f FROM jobs WHERE wall IS NOT NULL)
    SELECT round(quantile_cont(wall,0.5) FILTER (WHERE f),6) AS first_median, round(coalesce(quantile_cont(wall,0.5) FILTER (WHERE NOT f), quantile_cont(wall,0.5) FILTER (WHERE f)),6) AS repeat_median FROM m"""))
def a52(spark, sf):
    out = K.first_and_repeat(V.jobs(spark, sf), "complex", ["ts", "key"], "wall")
    return out.select(F.round("first_median", 6).alias("first_median"), F.round("repeat_median", 6).alias("repeat_median"))


@query("A53_squared_share", sql("jobs", """
    WITH c AS (SELECT complex, min(residues) AS s, count(*) AS jobs FROM jobs GROUP BY complex)
    SELECT CASE WHEN s <= 600 THEN 'small' ELSE 'large' END AS side, count(*) AS n_complexes, sum(jobs)::BIGINT AS n_jobs, round(sum(s*s)::DOUBLE/(SELECT sum(s*s) FROM c)::DOUBLE,6) AS share FROM c GROUP BY 1"""))
def a53(spark, sf):
    return K.squared_share(V.jobs(spark, sf), "complex", "residues", 600).withColumn("share", F.round("share", 6))


@query("A56_timing_summary", sql("jobs", """
    WITH l AS (SELECT device IS NOT NULL AS has_device, k >= 10 AS has_split, 'wall' AS name, wall AS v FROM jobs UNION ALL SELECT device IS NOT NULL, k >= 10, 'alignment', wall*0.25 FROM jobs WHERE k >= 10
      UNION ALL SELECT device IS NOT NULL, k >= 10, 'folding', wall*0.75 FROM jobs WHERE k >= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY has_device, has_split, name ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY has_device, has_split, name) AS n FROM l)
    SELECT has_device, has_split, name, any_value(n) AS n, round(min(v),6) AS min, round(max(v) FILTER (WHERE r = n//2),6) AS upper_median, round(max(v),6) AS max FROM r GROUP BY 1,2,3"""))
def a56(spark, sf):
    split = F.col("k") >= 10
    j = V.jobs(spark, sf).select(
        F.col("device").isNotNull().alias("has_device"), split.alias("has_split"), "wall",
        F.when(split, F.col("wall") * 0.25).alias("alignment"), F.when(split, F.col("wall") * 0.75).alias("folding"))
    out = K.timing_summary(j, ["has_device", "has_split"], ["wall", "alignment", "folding"])
    for c in ("min", "upper_median", "max"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("A57_skipped_split", sql("jobs", """
    SELECT beta, count(*) AS n, round(quantile_cont(wall,0.5),3) AS median_wall FROM jobs WHERE NOT coalesce(CASE WHEN k % 4 = 0 THEN true WHEN k % 4 <> 1 THEN false END, false) GROUP BY beta"""))
def a57(spark, sf):
    skipped = F.when(F.col("k") % 4 == 0, True).when(F.col("k") % 4 != 1, False)
    kept = V.jobs(spark, sf).where(~F.coalesce(skipped, F.lit(False)))
    m = medians(kept, ["beta"], ["wall"]).select("beta", F.round("median", 3).alias("median_wall"))
    return kept.groupBy("beta").agg(F.count(F.lit(1)).alias("n")).join(m, "beta")


@query("U03_concatenate", """
    SELECT 'F' AS chain, l_suppkey AS complex, sum(l_quantity)::BIGINT AS charge, NULL::BIGINT AS n FROM lineitem WHERE l_linestatus='F' GROUP BY 2
    UNION ALL SELECT 'O', l_suppkey, sum(l_quantity)::BIGINT, count(*) FROM lineitem WHERE l_linestatus='O' GROUP BY 2""")
def u03(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("complex"), "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))
    f = li.where("l_linestatus = 'F'").groupBy("complex").agg(F.sum("q").alias("charge")).withColumn("chain", F.lit("F"))
    o = li.where("l_linestatus = 'O'").groupBy("complex").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("charge")).withColumn("chain", F.lit("O"))
    return f.unionByName(o, allowMissingColumns=True)


@query("U04_replace_columns", """
    SELECT o_orderkey, o_custkey, n_lines, NULL::VARCHAR IS NULL AS replaced FROM (SELECT o.o_orderkey, o.o_custkey, l.n AS n_lines FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey=l.l_orderkey)""")
def u04(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(-1).cast("bigint").alias("n_lines"))
    n = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    out = K.replace_columns(o, ["o_orderkey"], n)
    return out.select("o_orderkey", "o_custkey", "n_lines", (F.coalesce("n_lines", F.lit(0)) >= 0).alias("replaced"))


@query("J20_job_list", sql("designs raw_test_set", """
    WITH ts AS (SELECT pdb_id, arg_min(chains, row_id) AS chains FROM raw_test_set GROUP BY pdb_id), known AS (SELECT DISTINCT pdb_id, CASE WHEN nation < 8 THEN 'Z' ELSE 'D' END AS chain, repeat('K', 20) AS native_seq FROM raw_test_set WHERE nation >= 4),
    j AS (SELECT d.*, t.chains, list_filter(t.chains, lambda c: c <> d.designed)[1] AS partner, d.pdb_id IN (SELECT pdb_id FROM known) AS is_known FROM designs d LEFT JOIN ts t USING (pdb_id))
    SELECT row_id, j.pdb_id, CASE WHEN chains IS NULL OR NOT is_known THEN 'entry not listed or not defined' WHEN partner IS NULL THEN 'no partner chain' WHEN k.native_seq IS NULL THEN 'no native sequence' END AS error,
      CASE WHEN chains IS NOT NULL AND is_known AND partner IS NOT NULL AND k.native_seq IS NOT NULL THEN length(sequence) + length(k.native_seq) END::BIGINT AS total_residues
    FROM j LEFT JOIN known k ON k.pdb_id = j.pdb_id AND k.chain = j.partner"""))
def j20(spark, sf):
    raw = V.raw_test_set(spark, sf)
    listed = raw.groupBy("pdb_id").agg(F.min_by("chains", "row_id").alias("chains"))
    # Entries of the first nations have no definition; those of the next ones lack the partner's.
    chain = F.when(F.col("nation") < 8, "Z").otherwise("D")
    defs = raw.where("nation >= 4").select("pdb_id", chain.alias("chain"), F.repeat(F.lit("K"), 20).alias("native_seq")).distinct()
    out = K.job_list(V.designs(spark, sf), listed, defs)
    total = F.aggregate(F.map_values("chain_map"), F.lit(0), lambda s, x: s + F.length(x))
    return out.select("row_id", "pdb_id", "error", total.cast("bigint").alias("total_residues"))
