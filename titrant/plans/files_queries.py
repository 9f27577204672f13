"""Sources and sinks. Each query writes a table-derived copy to the shared folder and reads it back."""

from pyspark.sql import functions as F

from titrant.operators import validation as C
from titrant.plans import views as V
from titrant.plans.contract_queries import ORDER
from titrant.plans.registry import query
from titrant.plans.spatial_queries import REGION_SQL, labelled
from titrant.plans.view_sql import sql
from titrant.session import new_folder
from titrant.sources import csv_tables, files, json_tables as J, sinks, text_lines as L
from titrant.streaming import landing

COLS = ", ".join(ORDER)


@query("S01_strict_csv_scan", sql("raw_designs", f"SELECT row_id::VARCHAR AS row_id, {COLS} FROM raw_designs"))
def s01(spark, sf):
    path = csv_tables.write_csv(V.raw_designs(spark, sf), "designs-csv")
    return csv_tables.read_strict(spark, path, ["row_id", *ORDER]).select("row_id", *ORDER)


@query("S02_header_check", "SELECT * FROM (VALUES ('duplicate','beta'),('missing','replicate'),('missing','net_charge_reported'),('unexpected','extra')) t(kind, column_name) WHERE (SELECT count(*) FROM orders) > 0")
def s02(spark, sf):
    raw = V.raw_designs(spark, sf).drop("row_id", "replicate").withColumnRenamed("net_charge_reported", "extra").withColumn("beta ", F.col("beta"))
    return csv_tables.header_problems(spark, csv_tables.write_csv(raw, "header-csv"), C.DESIGNS).select("kind", "column_name").distinct()


@query("S04_nested_definitions", sql("aa_dim", f"""WITH {REGION_SQL} SELECT structure, chain, count(*) AS n, count(*) FILTER (WHERE region='interface') AS n_interface, count(*) FILTER (WHERE region='core') AS n_core,
    coalesce(sum(pos) FILTER (WHERE region='interface'),0)::BIGINT AS interface_sum FROM labelled GROUP BY ALL"""))
def s04(spark, sf):
    # One record per entry; positions are gathered per chain only.
    lab = labelled(spark, sf).groupBy("structure", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "aa", "relative_area", "region"))).alias("r"))
    pick = lambda region: F.transform(F.filter("r", lambda x: x["region"] == region), lambda x: x["pos"].cast("int"))
    chain = F.struct(
        F.array_join(F.transform("r", lambda x: x["aa"]), "").alias("sequence"), F.transform("r", lambda x: x["relative_area"]).alias("relative_area"),
        pick("interface").alias("interface_positions"), pick("core").alias("core_positions"))
    per = lab.select("structure", F.struct("chain", chain.alias("c")).alias("e")).groupBy("structure").agg(F.map_from_entries(F.collect_list("e")).alias("chains"))
    doc = per.select(F.create_map(F.col("structure").cast("string"), F.struct(F.lit("native").alias("label_source"), "chains")).alias("definitions"))
    back = J.read_definitions(spark, J.write_json(doc, "definitions"))
    total = F.aggregate("interface_positions", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return back.select(
        F.col("entry").cast("bigint").alias("structure"), "chain", F.length("sequence").cast("bigint").alias("n"),
        F.size("interface_positions").cast("bigint").alias("n_interface"), F.size("core_positions").cast("bigint").alias("n_core"), total.alias("interface_sum"))


@query("S05_designs_export", sql("residues aa_dim", """
    WITH c AS (SELECT doc_id, any_value(source) AS source, count(*) AS n, sum(q)::DOUBLE AS q FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id)
    SELECT source, replicate::BIGINT AS replicate, count(*) AS n_designs, sum(n)::BIGINT AS n_letters, sum(CASE WHEN replicate = 0 THEN q ELSE 0.5 END) AS charge FROM c, (VALUES (0),(1)) r(replicate) GROUP BY ALL"""))
def s05(spark, sf):
    # The second design of each protein reports a charge, the first leaves it to the fallback.
    design = lambda charge: F.struct(F.col("seq").alias("sequence"), "beta", charge.alias("chain_net_charge"))
    protein = F.struct(F.col("source").alias("entry"), F.col("seq").alias("native_seq"), F.array(design(F.lit(None).cast("double")), design(F.lit(0.5))).alias("designs"))
    doc = V.seqs(spark, sf).select("source", F.array(protein).alias("proteins"))
    back = J.read_designs_export(spark, J.write_json(doc, "designs-export"))
    return back.groupBy(F.col("entry").alias("source"), F.col("replicate").cast("bigint").alias("replicate")).agg(
        F.count(F.lit(1)).alias("n_designs"), F.sum(F.length("sequence")).alias("n_letters"), F.sum("net_charge").alias("charge"))


def metrics_folder(spark, sf):
    """A metrics record per event, some of them broken, in one folder per dose."""
    j = V.jobs(spark, sf)
    good = F.to_json(F.struct(F.col("key").cast("string").alias("key"), F.col("complex").cast("string").alias("complex"), "beta", F.lit(0).alias("replicate"), F.col("wall").alias("score"), "wall", "device"))
    path = new_folder(spark, "metrics")
    j.select(F.when(F.col("k") == 7, F.concat(F.lit('{"key": '), F.col("key").cast("string"), F.lit(", broken"))).otherwise(good).alias("value"), "beta").write.partitionBy("beta").text(path)
    return path


@query("S06_many_json_files", sql("jobs", "SELECT CASE WHEN k = 7 THEN 'unreadable' ELSE 'good' END AS kind, count(*) AS n, round(coalesce(sum(wall) FILTER (WHERE k <> 7),0),3)::DOUBLE AS wall FROM jobs GROUP BY 1"))
def s06(spark, sf):
    good, bad = J.read_metrics(spark, metrics_folder(spark, sf))
    g = good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("wall"), 3).alias("wall"))
    b = bad.groupBy().agg(F.lit("unreadable").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("wall"))
    return g.unionByName(b)


@query("S12_optional_input", "SELECT doc_id, NULL::DOUBLE AS score, 'absent' AS status FROM documents")
def s12(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id")
    scores, there = files.read_if_present(spark, f"{sf}/fold_scores.parquet", "doc_id bigint, score double")
    return docs.join(scores, "doc_id", "left").withColumn("status", F.lit("present" if there else "absent"))


@query("S13_table_sink", sql("grid", "SELECT part, flag, beta, score FROM grid"))
def s13(spark, sf):
    path = new_folder(spark, "grid")
    sinks.write_table(V.grid(spark, sf).select("part", "flag", "beta", "score"), path)
    return spark.read.parquet(path)


@query("S14_per_dose_output", sql("grid", "SELECT beta, count(*) AS n, sum(CASE WHEN beta = 0 THEN 1 ELSE 0 END)::BIGINT AS rewritten FROM grid GROUP BY beta"))
def s14(spark, sf):
    path = new_folder(spark, "doses")
    g = V.grid(spark, sf).select("part", "flag", "beta", F.lit(0).cast("bigint").alias("rewritten"))
    sinks.write_doses(g, path)
    sinks.write_doses(g.where("beta = 0").withColumn("rewritten", F.lit(1).cast("bigint")), path)
    return spark.read.parquet(path).groupBy("beta").agg(F.count(F.lit(1)).alias("n"), F.sum("rewritten").alias("rewritten"))


@query("S15_ordered_output", sql("jobs", "SELECT complex, beta, key, failed, residues, wall FROM jobs"))
def s15(spark, sf):
    j = V.jobs(spark, sf).select("wall", "key", "residues", "beta", "failed", "complex")
    return sinks.in_order(j, ["complex", "beta", "key"], ["complex", "beta", "key"])


@query("S16_summary_sink", sql("jobs grid", "SELECT (SELECT count(*) FROM jobs) AS n_jobs, (SELECT count(*) FROM jobs WHERE failed) AS n_failed, (SELECT count(*) FROM grid) AS n_grid, (SELECT max(beta) FROM grid) AS top_dose"))
def s16(spark, sf):
    path = new_folder(spark, "summary")
    sinks.write_summary({
        "jobs": V.jobs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed")),
        "grid": V.grid(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.max("beta").alias("top_dose"))}, path)
    back = spark.read.schema("jobs struct<n: bigint, n_failed: bigint>, grid struct<n: bigint, top_dose: double>").json(path)
    return back.select(F.col("jobs.n").alias("n_jobs"), "jobs.n_failed", F.col("grid.n").alias("n_grid"), "grid.top_dose")


@query("S20_id_list", """
    SELECT id, count(*) AS n FROM (SELECT upper(unnest(regexp_split_to_array(trim(p_name), '\\s+'))) AS id FROM part) WHERE id <> '' GROUP BY id""")
def s20(spark, sf):
    path = new_folder(spark, "ids")
    V.table(spark, sf, "part").select(F.concat(F.lit("  "), "p_name").alias("value")).write.text(path)
    return L.id_list(spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("ST1_landing_files", sql("jobs", "SELECT key::VARCHAR AS key FROM jobs WHERE k = 7"))
def st1(spark, sf):
    folder, out, checkpoint = metrics_folder(spark, sf), new_folder(spark, "landed"), new_folder(spark, "landing-checkpoint")
    landing.collect_landed(spark, folder, out, checkpoint)
    expected = V.jobs(spark, sf).select(F.col("key").cast("string").alias("key"))
    return landing.missing(expected, landing.landed(spark, out))


@query("ST1_landing_account", sql("jobs", "SELECT count(*) AS n_records, count(*) FILTER (WHERE k <> 7) AS n_landed, 0::BIGINT AS n_repeated, count(*) FILTER (WHERE k = 7) AS n_unreadable FROM jobs"))
def st1_account(spark, sf):
    folder, out, checkpoint = metrics_folder(spark, sf), new_folder(spark, "landed"), new_folder(spark, "landing-checkpoint")
    landing.collect_landed(spark, folder, out, checkpoint)
    return landing.account(spark, out)
