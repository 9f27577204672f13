"""Scores over error matrices."""

from pyspark.sql import functions as F

from titrant.functions.score import d0_array, d0_scalar
from titrant.operators import matrix as M
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.sequence_queries import r6
from titrant.plans.view_sql import sql

A, B = V.FIRST_CHAIN, V.MATRIX_SIDE - V.FIRST_CHAIN
D0 = "greatest(1, 1.24*pow({n}-15.0::DOUBLE, 1/3.0::DOUBLE) - 1.8)"
SCALAR = "CASE WHEN {n} > 27 THEN " + D0.replace("{n}", "greatest({n},27)") + " ELSE 1 END::DOUBLE"
ARRAY = D0.replace("{n}", "greatest(26,{n})")


@query("F12_d0_scalar", sql("seqs", f"SELECT length(seq)::BIGINT AS n, count(*) AS n_docs, round({SCALAR.format(n='length(seq)')},9) AS d0 FROM seqs GROUP BY ALL"))
def f12(spark, sf):
    n = F.length("seq").cast("bigint")
    return V.seqs(spark, sf).groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("d0", F.round(d0_scalar(F.col("n")), 9))


@query("F13_d0_array", sql("seqs", f"SELECT length(seq)::BIGINT AS n, count(*) AS n_docs, round({ARRAY.format(n='length(seq)')},9)::DOUBLE AS d0 FROM seqs GROUP BY ALL"))
def f13(spark, sf):
    n = F.length("seq").cast("bigint")
    return V.seqs(spark, sf).groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("d0", F.round(d0_array(F.col("n")), 9))


SHAPE = f"""shape AS (SELECT job, count(*)={(A + B) ** 2} AND max(i)={A + B - 1} AND max(j)={A + B - 1} AS ok FROM pae GROUP BY job)"""


@query("A48_ipsae", sql("pae", f"""WITH {SHAPE}, crossed AS (SELECT pae.*, CASE WHEN i < {A} THEN '0to1' ELSE '1to0' END AS d FROM pae JOIN shape USING (job) WHERE ok AND (i < {A}) <> (j < {A})),
    placed AS (SELECT job, d, i, count(*) FILTER (WHERE pae < 10) AS k FROM crossed GROUP BY ALL),
    size AS (SELECT r.job, r.d, r.n + coalesce(c.n,0) AS n FROM (SELECT job, d, count(*) FILTER (WHERE k>0) AS n FROM placed GROUP BY ALL) r LEFT JOIN (SELECT job, d, count(DISTINCT j) AS n FROM crossed WHERE pae < 10 GROUP BY ALL) c ON r.job=c.job AND r.d=c.d),
    res AS (SELECT c.job, c.d, c.i, avg(1/(1+pow(pae/{ARRAY.format(n='k')},2))) AS d0res, avg(1/(1+pow(pae/({SCALAR.format(n='n')}),2))) AS d0dom, avg(1/(1+pow(pae/({SCALAR.format(n=str(A + B))}),2))) AS d0chn
      FROM crossed c JOIN placed p ON c.job=p.job AND c.d=p.d AND c.i=p.i JOIN size s ON c.job=s.job AND c.d=s.d WHERE pae < 10 GROUP BY ALL),
    top AS (SELECT s.job, s.d, s.n, coalesce(max(d0res),0) AS d0res, coalesce(max(d0dom),0) AS d0dom, coalesce(max(d0chn),0) AS d0chn FROM size s LEFT JOIN res r ON s.job=r.job AND s.d=r.d GROUP BY ALL)
    SELECT job, CASE WHEN NOT ok THEN 'matrix does not fit the chain lengths' END AS problem, """ + ", ".join(f"round(max(CASE WHEN d='{d}' THEN {m} END),6) AS {m}_{d}" for m in ("d0res", "d0dom", "d0chn") for d in ("0to1", "1to0")) + ", " + ", ".join(
    f"max(CASE WHEN d='{d}' THEN n END) AS n_interface_{d}" for d in ("0to1", "1to0")) + ", round(max(d0res),6) AS d0res, round(max(d0dom),6) AS d0dom, round(max(d0chn),6) AS d0chn FROM shape LEFT JOIN top USING (job) GROUP BY job, ok"))
def a48(spark, sf):
    out = M.ipsae(V.pae(spark, sf), A, B, 10.0)
    for c in out.columns:
        if c.startswith("d0"):
            out = out.withColumn(c, F.round(c, 6))
    return out


@query("A49_interface_error", sql("pae", f"""WITH {SHAPE}, b AS (SELECT job, (avg(pae) FILTER (WHERE i<{A} AND j>={A}) + avg(pae) FILTER (WHERE i>={A} AND j<{A}))/2 AS m FROM pae GROUP BY job)
    SELECT job, CASE WHEN ok THEN round(m,6) END AS interface_pae FROM b JOIN shape USING (job)"""))
def a49(spark, sf):
    return M.block_means(V.pae(spark, sf), A, B).withColumn("interface_pae", F.round("interface_pae", 6))


@query("S07_fold_scores", """
    SELECT vec_id, round(list_avg(embedding[1:40]::DOUBLE[]),6)+0.0 AS first_chain, round(list_avg(embedding[41:64]::DOUBLE[]),6)+0.0 AS second_chain, round(list_avg(embedding::DOUBLE[]),6)+0.0 AS overall FROM embeddings""")
def s07(spark, sf):
    from titrant.sources.json_tables import read_fold_scores, write_json

    # Scores as the external folder leaves them: scalars, a vector and a matrix per JSON record.
    e = V.table(spark, sf, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    scores = e.select(
        F.col("vec_id").cast("string").alias("job"), F.get(vector, 0).alias("ptm"), F.get(vector, 1).alias("iptm"), vector.alias("plddt"),
        F.array(F.slice(vector, 1, 32), F.slice(vector, 33, 32)).alias("pae"))
    back = read_fold_scores(spark, write_json(scores, "fold-scores"))
    means = M.chain_means(back, "job", "plddt", 40)
    return means.select(F.col("job").cast("bigint").alias("vec_id"), *[r6(F.col(c)).alias(c) for c in ("first_chain", "second_chain", "overall")])


@query("X04_matrix_to_rows", """
    SELECT vec_id, k // 32 AS i, k % 32 AS j, v::DOUBLE AS pae FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings)""")
def x04(spark, sf):
    e = V.table(spark, sf, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    nested = e.select("vec_id", F.array(F.slice(vector, 1, 32), F.slice(vector, 33, 32)).alias("pae"))
    return M.matrix_rows(nested, "vec_id")
