"""Slopes, intervals, permutation tests and matched nulls."""

from pyspark.sql import functions as F

from titrant.functions.charge import net_charge_ph, net_charge_simple, residue_charge_simple
from titrant.functions.hydropathy import place_on_diagram
from titrant.operators import matching_null as MN, membership as M, readings as RD, resample as B, slopes as S
from titrant.operators.joins import beside
from titrant.operators.ordering import average_ranks, quantiles
from titrant.operators.pairing import paired_change, paired_deltas
from titrant.plans import views as V
from titrant.session import keep
from titrant.plans.registry import query
from titrant.plans.sequence_queries import DIAGRAM_SQL, TERM, r6
from titrant.plans.view_sql import hashed_draws_sql, mixed_sql, resample_sql, sql

N = 10_000  # resamples in every registered query

SLOPE_SQL = """wide AS (SELECT {key}, beta,
      sum(CASE WHEN region='interface' THEN charge ELSE 0 END)::BIGINT AS ci, sum(CASE WHEN region='surface' THEN charge ELSE 0 END)::BIGINT AS cs,
      sum(CASE WHEN region='core' THEN charge ELSE 0 END)::BIGINT AS cc, sum(charge)::BIGINT AS ct,
      sum(CASE WHEN region='interface' THEN size ELSE 0 END)::BIGINT AS ni, sum(CASE WHEN region='surface' THEN size ELSE 0 END)::BIGINT AS ns,
      sum(CASE WHEN region='core' THEN size ELSE 0 END)::BIGINT AS nc, sum(size)::BIGINT AS nt FROM {resp} GROUP BY {key}, beta),
    shifts AS (SELECT w.{key}, w.beta, w.ni, w.ns, w.nc, w.nt, (w.ci-r.ci)::DOUBLE AS si, (w.cs-r.cs)::DOUBLE AS ss, (w.cc-r.cc)::DOUBLE AS sc, (w.ct-r.ct)::DOUBLE AS st
      FROM wide w JOIN (SELECT * FROM wide WHERE beta = 0) r USING ({key})),
    long AS (SELECT {key}, beta, 'interface' AS region, ni AS n, nt, si AS y, st AS x FROM shifts UNION ALL SELECT {key}, beta, 'surface', ns, nt, ss, st FROM shifts
      UNION ALL SELECT {key}, beta, 'core', nc, nt, sc, st FROM shifts),
    fitted AS (SELECT {key}, region, count(DISTINCT beta) AS n_betas, arg_min(n, beta) AS n_residues_region, arg_min(nt, beta) AS n_residues_total,
      CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x)/var_pop(x) END AS slope FROM long GROUP BY {key}, region),
    slopes{tag} AS (SELECT *, n_residues_region/n_residues_total AS residue_share, slope - n_residues_region/n_residues_total AS slope_minus_share,
      CASE WHEN n_residues_region > 0 THEN slope/(n_residues_region/n_residues_total) END AS ratio
      FROM fitted WHERE slope IS NOT NULL AND n_betas >= 3 AND n_residues_total > 0),
    gaps{tag} AS (SELECT {key}, max(ratio) FILTER (WHERE region='interface') AS interface, max(ratio) FILTER (WHERE region='surface') AS surface,
      max(ratio) FILTER (WHERE region='interface') - max(ratio) FILTER (WHERE region='surface') AS gap FROM slopes{tag} GROUP BY {key}
      HAVING max(ratio) FILTER (WHERE region='interface') IS NOT NULL AND max(ratio) FILTER (WHERE region='surface') IS NOT NULL)"""
ONE = SLOPE_SQL.format(key="complex", resp="resp", tag="")


def slopes(spark, sf):
    return S.region_slopes(S.region_shifts(V.resp(spark, sf), "complex"), ["complex"])


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, r6(F.col(n)))
    return df


@query("A15_region_slopes", sql("resp", f"""WITH {ONE}
    SELECT complex, region, n_residues_region, n_residues_total, n_betas, round(slope,6)+0.0 AS slope, round(residue_share,6)+0.0 AS residue_share,
      round(slope_minus_share,6)+0.0 AS slope_minus_share, round(ratio,6)+0.0 AS ratio FROM slopes"""))
def a15(spark, sf):
    return rounded(slopes(spark, sf), "slope", "residue_share", "slope_minus_share", "ratio")


@query("A16_against_share", sql("resp", f"""WITH {ONE}, {resample_sql('slopes', 'region', 'slope_minus_share', 'complex')},
    below AS (SELECT region, count(*) FILTER (WHERE slope_minus_share < 0) AS n_below_share FROM slopes GROUP BY region)
    SELECT region, estimate, low, high, n, excludes_zero, n_below_share FROM intervals JOIN below USING (region)"""))
def a16(spark, sf):
    s = keep(slopes(spark, sf))
    interval = B.bootstrap_interval(s, ["region"], "slope_minus_share", "complex", n_resamples=N)
    below = s.groupBy("region").agg(F.count_if(F.col("slope_minus_share") < 0).alias("n_below_share"))
    return rounded(interval.drop("n_resamples").join(below, "region"), "estimate", "low", "high")


@query("P17_reading_by_sign", sql("resp", f"""WITH {ONE}, {resample_sql('slopes', 'region', 'slope_minus_share', 'complex')}
    SELECT region, CASE WHEN estimate < 0 THEN 'less' ELSE 'more' END || CASE WHEN excludes_zero THEN '' ELSE ', but the interval includes zero' END AS reading FROM intervals"""))
def p17(spark, sf):
    interval = B.bootstrap_interval(slopes(spark, sf), ["region"], "slope_minus_share", "complex", n_resamples=N)
    return interval.select("region", RD.direction(F.col("estimate"), F.col("excludes_zero")).alias("reading"))


@query("A17_paired_region_test", sql("resp", f"""WITH {ONE}, {resample_sql('gaps', '', 'gap', 'complex')},
    means AS (SELECT round(avg(interface),6)+0.0 AS mean_interface, round(avg(surface),6)+0.0 AS mean_surface, count(*) FILTER (WHERE interface < surface) AS n_left_lower FROM gaps)
    SELECT estimate, low, high, n, excludes_zero, mean_interface, mean_surface, n_left_lower FROM intervals, means"""))
def a17(spark, sf):
    g = keep(S.region_gap(slopes(spark, sf), "complex"))
    interval = B.paired_interval(g, [], "interface", "surface", "complex", n_resamples=N).drop("n_resamples")
    means = g.agg(F.avg("interface").alias("mean_interface"), F.avg("surface").alias("mean_surface"),
                  F.count_if(F.col("interface") < F.col("surface")).alias("n_left_lower"))
    out = beside(interval, means)
    return rounded(out, "estimate", "low", "high", "mean_interface", "mean_surface")


@query("A55_sorted_gaps", sql("resp", f"""WITH {ONE}
    SELECT complex, round(gap,6)+0.0 AS gap, gap < 0 AS below FROM gaps"""))
def a55(spark, sf):
    g = S.region_gap(slopes(spark, sf), "complex")
    return g.orderBy("gap", "complex").select("complex", r6(F.col("gap")).alias("gap"), (F.col("gap") < 0).alias("below"))


def survival(spark, sf):
    """Mean change of a score per supplier against the supplier's own reference dose."""
    li = V.table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("complex"), F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") - 1).cast("double").alias("beta")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count(F.lit(1))).alias("score"))
    change = paired_change(g, ["complex", "flag"], "score")
    return change.groupBy("complex").agg(F.avg("delta").alias("survival"))


SURVIVAL_SQL = """sg AS (SELECT l_suppkey AS complex, l_returnflag AS flag, (l_linenumber-1)::DOUBLE AS beta, sum(round(l_extendedprice*100)::BIGINT)::BIGINT/count(*) AS score FROM lineitem GROUP BY ALL),
    survival AS (SELECT a.complex, avg(a.score - b.score) AS survival FROM sg a JOIN sg b ON a.complex=b.complex AND a.flag=b.flag AND b.beta=0 WHERE a.beta<>0 GROUP BY a.complex),
    linked AS (SELECT complex, round(gap,9) AS x, round(survival,3) AS y FROM gaps JOIN survival USING (complex))"""


def rank_sql(source, groups, x, y, out, weight_groups=None):
    part = f"PARTITION BY {groups}" if groups else ""
    sel = f"{groups}, " if groups else ""
    return f"""{out}_r AS (SELECT *, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {sel}{x}) - 1)/2 AS rx,
      rank() OVER ({part} ORDER BY {y}) + (count(*) OVER (PARTITION BY {sel}{y}) - 1)/2 AS ry FROM {source}),
    {out} AS (SELECT {sel}count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry)/(stddev_pop(rx)*stddev_pop(ry)) END AS rho FROM {out}_r {'GROUP BY '+groups if groups else ''})"""


def spearman_interval_sql(source, groups, x, y, unit, n=N, seed=0):
    g = [c.strip() for c in groups.split(",") if c.strip()]
    sel = "".join(f"{c}, " for c in g)
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    tag = "||'|'||".join([f"'{seed}'"] + [f"{c}::VARCHAR" for c in g])
    using = "".join(f"v.{c} = d.{c} AND " for c in g)
    dsel = "".join(f"d.{c}, " for c in g)
    grp = f"GROUP BY {', '.join(g)}" if g else ""
    return f"""s_slots AS (SELECT {sel}{x} AS x, {y} AS y, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY md5({tag}||'|'||({unit})::VARCHAR)) - 1 AS slot FROM {source}),
    {hashed_draws_sql('s_slots', 's_draws', tag, sel, n)},
    s_pairs AS (SELECT {dsel}d.rep, v.x, v.y FROM s_draws d JOIN s_slots v ON {using}v.slot = d.h % d.n),
    {rank_sql('s_pairs', sel + 'rep', 'x', 'y', 's_reps')},
    s_spread AS (SELECT {sel}quantile_cont(rho,0.025) AS low, quantile_cont(rho,0.975) AS high, count(*) AS n_resamples FROM s_reps WHERE rho IS NOT NULL {grp}),
    {rank_sql('s_slots', ', '.join(g), 'x', 'y', 's_point')}"""


def permutation_sql(source, groups, x, y, unit, n=N, seed=0):
    g = [c.strip() for c in groups.split(",") if c.strip()]
    sel = "".join(f"{c}, " for c in g)
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    tag = "||'|'||".join([f"'{seed}'"] + [f"{c}::VARCHAR" for c in g])
    using = "".join(f"a.{c} = b.{c} AND " for c in g)
    asel = "".join(f"a.{c}, " for c in g)
    on = " AND ".join(f"p.{c} = o.{c}" for c in g) or "true"
    psel = "".join(f"p.{c}, " for c in g)
    grp = "GROUP BY " + ", ".join([f"p.{c}" for c in g] + ["o.n", "o.rho"])
    return f"""{rank_sql(source, ', '.join(g), x, y, 'p_obs')},
    p_slots AS (SELECT {sel}rx, ry, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY md5({tag}||'|'||({unit})::VARCHAR)) - 1 AS slot FROM p_obs_r),
    {hashed_draws_sql('p_slots', 'p_draws', tag, sel, n, ', ry')},
    p_shuffled AS (SELECT {sel}rep, ry, row_number() OVER (PARTITION BY {sel}rep ORDER BY h, slot) - 1 AS slot FROM p_draws),
    p_reps AS (SELECT {asel}a.rep, CASE WHEN var_pop(b.rx) > 0 AND var_pop(a.ry) > 0 THEN covar_pop(b.rx, a.ry)/(stddev_pop(b.rx)*stddev_pop(a.ry)) END AS rho
      FROM p_shuffled a JOIN p_slots b ON {using}a.slot = b.slot GROUP BY {asel}a.rep),
    p_tests AS (SELECT {psel}o.n, o.rho, (count(*) FILTER (WHERE abs(p.rho) >= abs(o.rho) - 1e-12) + 1) / ({n} + 1) AS p FROM p_reps p JOIN p_obs o ON {on} {grp})"""


def linked(spark, sf):
    gaps = S.region_gap(slopes(spark, sf), "complex").select("complex", F.round("gap", 9).alias("x"))
    return gaps.join(survival(spark, sf), "complex").select("complex", "x", F.round("survival", 3).alias("y"))


@query("A26_link_of_two_statistics", sql("resp", f"""WITH {ONE}, {SURVIVAL_SQL}, {spearman_interval_sql('linked', '', 'x', 'y', 'complex')}, {permutation_sql('linked', '', 'x', 'y', 'complex')}
    SELECT CASE WHEN t.n >= 10 THEN 'reported' ELSE 'too few complexes' END AS status, t.n, CASE WHEN t.n >= 10 THEN round(t.rho,6)+0.0 END AS rho, CASE WHEN t.n >= 10 THEN round(t.p,6) END AS p,
      CASE WHEN t.n >= 10 THEN round(low,6)+0.0 END AS low, CASE WHEN t.n >= 10 THEN round(high,6)+0.0 END AS high FROM p_tests t, s_spread"""))
def a26(spark, sf):
    both = keep(linked(spark, sf))
    test = B.spearman_permutation(both, [], "x", "y", "complex", n_permutations=N)
    interval = B.spearman_interval(both, [], "x", "y", "complex", n_resamples=N).select("low", "high")
    out = beside(test, interval)
    enough = F.col("n") >= 10
    return out.select(
        F.when(enough, "reported").otherwise("too few complexes").alias("status"), "n",
        *[F.when(enough, r6(F.col(c))).alias(c) for c in ("rho", "p", "low", "high")])


@query("A27_difference_of_arms", sql("", f"""
    WITH resp_o AS (SELECT l_suppkey AS complex, (l_linenumber-1)::DOUBLE AS beta, CASE l_returnflag WHEN 'A' THEN 'interface' WHEN 'R' THEN 'core' ELSE 'surface' END AS region,
      l_linestatus AS arm, sum(l_quantity)::BIGINT AS charge, count(*) AS size FROM lineitem GROUP BY ALL),
    arm_o AS (SELECT * FROM resp_o WHERE arm='O'), arm_f AS (SELECT * FROM resp_o WHERE arm='F'),
    o AS (WITH {SLOPE_SQL.format(key='complex', resp='arm_o', tag='')} SELECT * FROM gaps),
    f AS (WITH {SLOPE_SQL.format(key='complex', resp='arm_f', tag='')} SELECT * FROM gaps),
    arms AS (SELECT complex, o.gap AS gap_o, f.gap AS gap_f, o.gap - f.gap AS difference FROM o JOIN f USING (complex)),
    stacked AS (SELECT complex, 'difference' AS what, difference AS v FROM arms UNION ALL SELECT complex, 'gap_f', gap_f FROM arms UNION ALL SELECT complex, 'gap_o', gap_o FROM arms),
    {resample_sql('stacked', 'what', 'v', 'complex')}, pos AS (SELECT what, count(*) FILTER (WHERE v > 0) AS n_positive FROM stacked GROUP BY what)
    SELECT what, estimate, low, high, n, excludes_zero, n_positive FROM intervals JOIN pos USING (what)"""))
def a27(spark, sf):
    li = V.table(spark, sf, "lineitem")
    region = F.when(F.col("l_returnflag") == "A", "interface").when(F.col("l_returnflag") == "R", "core").otherwise("surface")
    resp = li.groupBy(F.col("l_suppkey").alias("complex"), F.col("l_linestatus").alias("arm"), (F.col("l_linenumber") - 1).cast("double").alias("beta"), region.alias("region")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("charge"), F.count(F.lit(1)).alias("size"))
    arm = lambda a: S.region_gap(S.region_slopes(S.region_shifts(resp.where(F.col("arm") == a), "complex"), ["complex"]), "complex").select("complex", F.col("gap").alias(f"gap_{a.lower()}"))
    arms = arm("O").join(arm("F"), "complex").withColumn("difference", F.col("gap_o") - F.col("gap_f"))
    cells = F.array(*[F.struct(F.lit(w).alias("what"), F.col(w).alias("v")) for w in ("difference", "gap_f", "gap_o")])
    long = keep(arms.select("complex", F.explode(cells).alias("c")).select("complex", "c.what", "c.v"))
    interval = B.bootstrap_interval(long, ["what"], "v", "complex", n_resamples=N).drop("n_resamples")
    positive = long.groupBy("what").agg(F.count_if(F.col("v") > 0).alias("n_positive"))
    return rounded(interval.join(positive, "what"), "estimate", "low", "high")


@query("A29_bootstrap_interval", sql("", f"""
    WITH units AS (SELECT c_mktsegment AS segment, c_custkey AS unit, sqrt(c_acctbal + 1000) AS v0 FROM customer), {resample_sql('units', 'segment', 'v0', 'unit')}
    SELECT segment, estimate AS balance, low AS balance_ci_low, high AS balance_ci_high, 0.95::DOUBLE AS balance_ci_confidence, n AS balance_n, excludes_zero FROM intervals"""))
def a29(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("unit"), F.sqrt(F.col("c_acctbal") + 1000).alias("v0"))
    interval = rounded(B.bootstrap_interval(c, ["segment"], "v0", "unit", n_resamples=N), "estimate", "low", "high").drop("n_resamples")
    flags = interval.select("segment", "excludes_zero")
    return B.prefixed(interval, "balance").join(flags, "segment")


@query("A30_paired_bootstrap", sql("", f"""
    WITH units AS (SELECT p_brand AS brand, p_partkey AS unit, sqrt(p_retailprice) - sqrt(p_size::DOUBLE) AS v0 FROM part), {resample_sql('units', 'brand', 'v0', 'unit')}
    SELECT * FROM intervals"""))
def a30(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("unit"), F.sqrt("p_retailprice").alias("l"), F.sqrt("p_size").alias("r"))
    return rounded(B.paired_interval(p, ["brand"], "l", "r", "unit", n_resamples=N), "estimate", "low", "high").drop("n_resamples")


@query("X01_pluggable_statistic", sql("", f"""
    WITH units AS (SELECT c_mktsegment AS segment, c_custkey AS unit, sqrt(c_acctbal + 1000) AS v0 FROM customer),
    a AS (WITH {resample_sql('units', 'segment', 'v0', 'unit', 'median', N)} SELECT 'median' AS statistic, * FROM intervals),
    b AS (WITH {resample_sql('units', 'segment', 'v0', 'unit', 'stddev_pop', N)} SELECT 'spread' AS statistic, * FROM intervals)
    SELECT * FROM a UNION ALL SELECT * FROM b"""))
def x01(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("unit"), F.sqrt(F.col("c_acctbal") + 1000).alias("v0"))
    run = lambda name, s: B.bootstrap_interval(c, ["segment"], "v0", "unit", n_resamples=N, statistic=s).withColumn("statistic", F.lit(name))
    out = run("median", "median").unionByName(run("spread", F.stddev_pop))
    return rounded(out, "estimate", "low", "high").drop("n_resamples")


@query("A22_paired_change_by_dose", sql("grid", f"""
    WITH change AS (SELECT g.part, g.beta, g.score - r.score AS delta FROM grid g JOIN (SELECT * FROM grid WHERE beta = 0) r USING (part, flag) WHERE g.beta <> 0),
    per AS (SELECT part, beta, avg(delta) AS delta FROM change GROUP BY ALL), {resample_sql('per', 'beta', 'delta', 'part')},
    fell AS (SELECT beta, count(*) FILTER (WHERE delta < 0) AS n_degraded, count(*) FILTER (WHERE delta < 0)/count(*) AS fraction_degraded FROM per GROUP BY beta)
    SELECT beta, estimate, low, high, n, excludes_zero, n_degraded, fraction_degraded FROM intervals JOIN fell USING (beta)"""))
def a22(spark, sf):
    return rounded(summarise_change(paired_change(V.grid(spark, sf), V.LINEAGE, "score"), "part"), "estimate", "low", "high")


def summarise_change(change, unit, lower_is_better=False, n=N):
    """One value per complex first, so replicates of a complex do not count twice."""
    per = keep(change.groupBy(unit, "beta").agg(F.avg("delta").alias("delta")))
    interval = B.bootstrap_interval(per, ["beta"], "delta", unit, n_resamples=n).drop("n_resamples")
    worse = F.col("delta") > 0 if lower_is_better else F.col("delta") < 0
    fell = per.groupBy("beta").agg(F.count_if(worse).alias("n_degraded"), (F.count_if(worse) / F.count(F.lit(1))).alias("fraction_degraded"))
    return interval.join(fell, "beta")


@query("P18_quality_reading", sql("grid", f"""
    WITH held AS (SELECT g.* FROM grid g LEFT JOIN (SELECT * FROM grid WHERE beta = 0) r USING (part, flag) WHERE r.conf IS NULL OR r.conf - g.conf <= 10),
    c1 AS (SELECT 'all_returned' AS subset, g.part, g.beta, g.score - r.score AS delta FROM grid g JOIN (SELECT * FROM grid WHERE beta = 0) r USING (part, flag) WHERE g.beta <> 0),
    c2 AS (SELECT 'held_up' AS subset, g.part, g.beta, g.score - r.score AS delta FROM held g JOIN (SELECT * FROM held WHERE beta = 0) r USING (part, flag) WHERE g.beta <> 0),
    per AS (SELECT subset, part, beta, avg(delta) AS delta FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY ALL), {resample_sql('per', 'subset, beta', 'delta', 'part')},
    seen AS (SELECT coalesce(bool_or(subset='all_returned' AND excludes_zero AND estimate<0),false) AS overall, coalesce(bool_or(subset<>'all_returned' AND excludes_zero AND estimate<0),false) AS folded FROM intervals)
    SELECT overall, folded, true AS controlled, CASE WHEN overall AND folded THEN 'degrades, also among rows that held up' WHEN overall THEN 'degrades overall but not among rows that held up'
      WHEN folded THEN 'degrades only among rows that held up: selection on a collider' ELSE 'no measurable degradation' END AS reading FROM seen"""))
def p18(spark, sf):
    # A lineage's reference has lost nothing of itself, so it is held up and one comparison serves both subsets.
    change = paired_deltas(V.grid(spark, sf), V.LINEAGE, ["score", "conf"]).where("beta <> 0 AND delta_score IS NOT NULL")
    held = F.col("delta_conf").isNull() | (F.col("delta_conf") >= -10.0)
    per = change.groupBy("part", "beta").agg(F.avg("delta_score").alias("all"), F.avg(F.when(held, F.col("delta_score"))).alias("held"))
    both = F.array(*[F.struct(F.lit(name).alias("subset"), F.col(c).alias("delta")) for name, c in (("all_returned", "all"), ("held_up", "held"))])
    per = per.select("part", "beta", F.inline(both))
    return RD.quality_of(B.fallen(per, ["subset", "beta"], ["subset"], "delta", "part", n_resamples=N))


CHARGES_SQL = f"""charges AS (SELECT doc_id, lang, sum(q)::DOUBLE AS simple, round(sum(qph + {TERM}), 6) AS ph FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id, lang)"""


def charges(spark, sf):
    s = V.seqs(spark, sf)
    return s.select("doc_id", "lang", net_charge_simple(F.col("seq")).cast("double").alias("simple"), F.round(net_charge_ph(F.col("seq")), 6).alias("ph"))


@query("A31_window_membership", sql("residues aa_dim", f"""WITH {CHARGES_SQL}, marked AS (SELECT lang, doc_id, (simple BETWEEN -20 AND 20)::INTEGER::DOUBLE AS inside, abs(simple - 0) AS ae FROM charges),
    {resample_sql('marked', 'lang', 'inside', 'doc_id')}
    SELECT i.lang, i.n, i.low AS ci_low, i.high AS ci_high, n_inside, fraction_inside, mean_absolute_error, median_absolute_error, mae > 40 AS mae_exceeds_window FROM intervals i JOIN
      (SELECT lang, sum(inside)::BIGINT AS n_inside, round(avg(inside),6) AS fraction_inside, avg(ae) AS mae, round(avg(ae),6) AS mean_absolute_error, round(quantile_cont(ae,0.5),6) AS median_absolute_error FROM marked GROUP BY lang) USING (lang)"""))
def a31(spark, sf):
    out = M.window_summary(charges(spark, sf), ["lang"], "simple", "doc_id", -20.0, 20.0, n_resamples=N)
    return rounded(out, "ci_low", "ci_high", "fraction_inside", "mean_absolute_error", "median_absolute_error")


@query("A32_membership_disagreement", sql("residues aa_dim", f"""WITH {CHARGES_SQL}
    SELECT lang, count(*) AS n, count(*) FILTER (WHERE a) AS n_inside_a, count(*) FILTER (WHERE b) AS n_inside_b, count(*) FILTER (WHERE a<>b) AS n_disagree,
      count(*) FILTER (WHERE a AND NOT b) AS n_only_a, count(*) FILTER (WHERE b AND NOT a) AS n_only_b, round(avg(simple-ph),6)+0.0 AS mean_offset, round(quantile_cont(simple-ph,0.5),6)+0.0 AS median_offset,
      round(max(abs(simple-ph)),6)+0.0 AS max_absolute_offset, max(simple-ph)-min(simple-ph) < 1e-9 AS offset_is_constant
    FROM (SELECT *, simple BETWEEN -20 AND 20 AS a, ph BETWEEN -20 AND 20 AS b FROM charges) GROUP BY lang"""))
def a32(spark, sf):
    out = M.disagreement(charges(spark, sf), ["lang"], "simple", "ph", -20.0, 20.0)
    return rounded(out, "mean_offset", "median_offset", "max_absolute_offset")


@query("A33_spearman", sql("residues aa_dim", f"""WITH {CHARGES_SQL}, {rank_sql('charges', 'lang', 'simple', 'ph', 'rho_t')}
    SELECT lang, n, round(rho,6)+0.0 AS rho FROM rho_t"""))
def a33(spark, sf):
    return rounded(B.spearman(charges(spark, sf), ["lang"], "simple", "ph"), "rho")


@query("W01_average_rank", """
    SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1)/2 AS price_rank,
      rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1)/2 AS customer_rank FROM orders""")
def w01(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    price = average_ranks(o, [], "o_totalprice").select(F.col("value").alias("o_totalprice"), F.col("rank").alias("price_rank"))
    cust = average_ranks(o, ["o_orderstatus"], "o_custkey").select("o_orderstatus", F.col("value").alias("o_custkey"), F.col("rank").alias("customer_rank"))
    return o.join(price, "o_totalprice").join(cust, ["o_orderstatus", "o_custkey"]).select("o_orderkey", "price_rank", "customer_rank")


def xy(spark, sf):
    return V.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("double").alias("x"), F.round("c_acctbal", -2).alias("y"))


XY_SQL = "xy AS (SELECT c_mktsegment AS segment, c_custkey AS unit, c_nationkey::DOUBLE AS x, round(c_acctbal, -2) AS y FROM customer)"


@query("A34_permutation_p", sql("", f"""WITH {XY_SQL}, {permutation_sql('xy', 'segment', 'x', 'y', 'unit')}
    SELECT segment, n, round(rho,6)+0.0 AS rho, round(p,6) AS p FROM p_tests"""))
def a34(spark, sf):
    return rounded(B.spearman_permutation(xy(spark, sf), ["segment"], "x", "y", "unit", n_permutations=N), "rho", "p")


@query("A35_spearman_interval", sql("", f"""WITH {XY_SQL}, {spearman_interval_sql('xy', 'segment', 'x', 'y', 'unit')}
    SELECT segment, n, round(rho,6)+0.0 AS estimate, round(low,6)+0.0 AS low, round(high,6)+0.0 AS high, n_resamples, low > 0 OR high < 0 AS excludes_zero FROM s_point JOIN s_spread USING (segment)"""))
def a35(spark, sf):
    return rounded(B.spearman_interval(xy(spark, sf), ["segment"], "x", "y", "unit", n_resamples=N), "estimate", "low", "high")


@query("A36_unequal_sizes", """
    SELECT count(DISTINCT n) > 1 AS unequal, string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) IS NOT NULL AS has_sizes, min(n) AS smallest, max(n) AS largest
    FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)""")
def a36(spark, sf):
    c = V.table(spark, sf, "customer")
    out = M.unequal_sizes(c, "c_nationkey")
    sizes = F.transform(F.split("sizes", ","), lambda s: s.cast("bigint"))
    return out.select("unequal", F.col("sizes").isNotNull().alias("has_sizes"), F.array_min(sizes).alias("smallest"), F.array_max(sizes).alias("largest"))


FOLD_SQL = f"""{DIAGRAM_SQL}, merged AS (SELECT d.doc_id, d.beta, round(distance_from_boundary,9) AS distance, predicted_disordered AS outside, folded::INTEGER::DOUBLE AS folded, rmsd FROM diagram d JOIN folded f USING (doc_id))"""


def merged(spark, sf):
    d = place_on_diagram(V.scored(spark, sf, V.seqs(spark, sf)))
    return d.join(V.folded(spark, sf), "doc_id").select(
        "doc_id", "beta", F.round("distance_from_boundary", 9).alias("distance"), F.col("predicted_disordered").alias("outside"),
        F.col("folded").cast("int").cast("double").alias("folded"), "rmsd")


@query("A41_inside_outside_rates", sql("residues aa_dim folded", f"""WITH {FOLD_SQL}, {resample_sql('merged', 'outside', 'folded', 'doc_id')}
    SELECT outside, estimate AS fold_rate, low, high, n, median_rmsd FROM intervals JOIN (SELECT outside, round(quantile_cont(rmsd,0.5),6) AS median_rmsd FROM merged GROUP BY outside) USING (outside)"""))
def a41(spark, sf):
    m = keep(merged(spark, sf))
    rate = B.bootstrap_interval(m, ["outside"], "folded", "doc_id", n_resamples=N).select("outside", F.col("estimate").alias("fold_rate"), "low", "high", "n")
    middle = quantiles(m, ["outside"], "rmsd", {"median_rmsd": 0.5})
    return rounded(rate.join(middle, "outside"), "fold_rate", "low", "high", "median_rmsd")


@query("A42_within_dose_correlation", sql("residues aa_dim folded", f"""WITH {FOLD_SQL}, {permutation_sql('merged', 'beta', 'distance', 'rmsd', 'doc_id')},
    per AS (SELECT t.beta, t.n, t.rho, t.p, m.fold_rate, m.median_rmsd FROM p_tests t JOIN (SELECT beta, avg(folded) AS fold_rate, quantile_cont(rmsd,0.5) AS median_rmsd FROM merged GROUP BY beta) m USING (beta))
    SELECT beta, n, round(rho,6)+0.0 AS rho, round(p,6) AS p, round(fold_rate,6) AS fold_rate, round(median_rmsd,6) AS median_rmsd FROM per
    UNION ALL SELECT NULL, sum(n)::BIGINT, round(avg(rho) FILTER (WHERE n >= 3),6)+0.0, NULL, NULL, NULL FROM per"""))
def a42(spark, sf):
    m = keep(merged(spark, sf))
    tests = B.spearman_permutation(m, ["beta"], "distance", "rmsd", "doc_id", n_permutations=N)
    rates = m.groupBy("beta").agg(F.avg("folded").alias("fold_rate")).join(quantiles(m, ["beta"], "rmsd", {"median_rmsd": 0.5}), "beta")
    per = keep(tests.join(rates, "beta"))
    mean = per.agg(F.sum("n").alias("n"), F.avg(F.when(F.col("n") >= 3, F.col("rho"))).alias("rho"))
    return rounded(per.unionByName(mean, allowMissingColumns=True), "rho", "p", "fold_rate", "median_rmsd")


# ---- position slopes and the matched null -----------------------------------------------------

POSITION_SQL = """totals AS (SELECT doc_id, sum(q)::DOUBLE AS total FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id),
    pslopes AS (SELECT lang, pos, CASE WHEN var_pop(total) > 0 THEN covar_pop(q::DOUBLE, total)/var_pop(total) END AS slope, count(*) AS n_designs
      FROM residues JOIN aa_dim USING (aa) JOIN totals USING (doc_id) GROUP BY lang, pos),
    positions AS (SELECT lang, pos, slope, n_designs, ((pos*37) % 100)/100 AS area, CASE WHEN pos % 4 = 0 THEN 'interface' WHEN pos % 4 = 1 THEN 'core' ELSE 'surface' END AS region
      FROM pslopes WHERE slope IS NOT NULL)"""


def positions(spark, sf):
    s = V.seqs(spark, sf).withColumn("total", net_charge_simple(F.col("seq")).cast("double"))
    long = s.select("lang", "total", F.posexplode(F.split("seq", "")).alias("pos", "aa")).withColumn("q", residue_charge_simple(F.col("aa")).cast("double"))
    p = S.position_slopes(long, ["lang"], "q", "total")
    return p.withColumn("area", F.col("pos") * 37 % 100 / 100).withColumn("region", V.region_label(F.col("pos")))


@query("A37_position_slopes", sql("residues aa_dim", f"WITH {POSITION_SQL} SELECT lang, pos, n_designs, round(slope,6)+0.0 AS slope FROM positions"))
def a37(spark, sf):
    return rounded(positions(spark, sf).select("lang", "pos", "n_designs", "slope"), "slope")


DRAWS = 20
MATCH_SQL = f"""binned AS (SELECT *, floor(area/0.1) AS stratum FROM positions),
    targets AS (SELECT lang, stratum, area AS wanted_area, row_number() OVER (PARTITION BY lang, stratum ORDER BY area, pos) - 1 AS slot FROM binned WHERE region='interface'),
    wanted AS (SELECT lang, stratum, count(*) AS wanted FROM targets GROUP BY ALL),
    placed AS (SELECT b.lang, b.stratum, b.pos, b.slope, b.area, r AS rep, wanted, row_number() OVER (PARTITION BY b.lang, b.stratum, r ORDER BY md5('0|'||b.lang||'|'||r||'|'||b.pos)) - 1 AS slot
      FROM binned b JOIN wanted w ON b.lang=w.lang AND b.stratum=w.stratum, range({DRAWS}) t(r) WHERE b.region='surface'),
    sample AS (SELECT placed.*, wanted_area FROM placed JOIN targets USING (lang, stratum, slot) WHERE slot < wanted)"""


@query("J18_matched_strata", sql("residues aa_dim", f"""WITH {POSITION_SQL}, {MATCH_SQL}
    SELECT lang, rep, count(*) AS n, sum(pos)::BIGINT AS pos_sum, round(sum(slope),6)+0.0 AS slope_sum FROM sample GROUP BY ALL"""))
def j18(spark, sf):
    sample = S.matched_draws(positions(spark, sf), "lang", "area", width=0.1, n_draws=DRAWS, seed=0)
    return sample.groupBy("lang", "rep").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"), r6(F.sum("slope")).alias("slope_sum"))


NULL_RATIOS = ("observed_ratio", "null_mean_ratio", "null_sd_ratio", "observed_minus_null", "p_permutation", "mean_match_error")


@query("A38_matched_null", sql("residues aa_dim", f"""WITH {POSITION_SQL}, {MATCH_SQL},
    obs AS (SELECT lang, count(*) AS n_residues, count(*) FILTER (WHERE region='interface') AS n_interface, count(*) FILTER (WHERE region='surface') AS n_surface_pool,
      sum(slope) FILTER (WHERE region='interface') / nullif(count(*) FILTER (WHERE region='interface')/count(*), 0) AS observed_ratio FROM positions GROUP BY lang),
    reps AS (SELECT s.lang, rep, count(*) AS k, sum(slope)/(count(*)/any_value(n_residues)) AS ratio, avg(abs(area - wanted_area)) AS error FROM sample s JOIN obs USING (lang)
      WHERE n_interface > 0 AND n_surface_pool >= n_interface GROUP BY s.lang, rep),
    cen AS (SELECT lang, avg(ratio) AS m, stddev_samp(ratio) AS sd FROM reps GROUP BY lang),
    tested AS (SELECT lang, max(k) AS k, round(any_value(observed_ratio),6)+0.0 AS observed_ratio, round(any_value(m),6)+0.0 AS null_mean_ratio, round(any_value(sd),6)+0.0 AS null_sd_ratio,
      round(any_value(observed_ratio - m),6)+0.0 AS observed_minus_null, round((count(*) FILTER (WHERE abs(ratio - m) >= abs(observed_ratio - m)) + 1)/(count(*)+1),6) AS p_permutation,
      round(avg(error),6)+0.0 AS mean_match_error FROM reps JOIN cen USING (lang) JOIN obs USING (lang) GROUP BY lang)
    SELECT o.lang, CASE WHEN n_interface = 0 THEN 'skipped: no interface' WHEN n_surface_pool < n_interface THEN 'skipped: surface pool smaller than interface'
        WHEN k IS NULL THEN 'skipped: no stratum in common' WHEN k < n_interface THEN 'matched in part' ELSE 'matched' END AS status,
      n_residues, n_interface, n_surface_pool, coalesce(k, 0) AS n_sampled, t.observed_ratio, null_mean_ratio, null_sd_ratio, observed_minus_null, p_permutation, mean_match_error
    FROM obs o LEFT JOIN tested t USING (lang)"""))
def a38(spark, sf):
    p = keep(positions(spark, sf))
    out = S.matched_null(p, "lang", "area", n_draws=DRAWS)
    return rounded(out, *NULL_RATIOS).select("lang", "status", "n_residues", "n_interface", "n_surface_pool", "n_sampled", *NULL_RATIOS)


COMPLEX_SIZE = 400


def complexes(spark, sf):
    """Positions of complexes of up to 400 residues; the last one of a language may be a short one."""
    part = F.concat_ws("-", "lang", F.floor(F.col("pos") / COMPLEX_SIZE).cast("string"))
    return positions(spark, sf).withColumn("complex", part)


NEAREST_SQL = f"""placed AS (SELECT *, lang||'-'||(pos // {COMPLEX_SIZE}) AS complex FROM positions),
    targets AS (SELECT complex, pos AS target, area AS wanted, row_number() OVER (PARTITION BY complex ORDER BY pos) AS k FROM placed WHERE region = 'interface'),
    places AS (SELECT complex, pos, area, {mixed_sql("(pos + ('0x'||substr(md5('0|'||complex),1,7))::BIGINT) % 2147483647", 'hs')} FROM placed WHERE region = 'surface'),
    draws AS (SELECT r AS rep, {mixed_sql('r + 1000003', 'hr')} FROM range(2) t(r)),
    hashed AS (SELECT complex, rep, pos, area, {mixed_sql('hs + hr', 'h')} FROM places, draws),
    pools AS (SELECT complex, rep, list(struct_pack(pos := pos, area := area, h := h)) AS pool FROM hashed GROUP BY ALL),
    walk AS (SELECT complex, rep, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::STRUCT(error DOUBLE, h BIGINT, pos BIGINT, area DOUBLE) AS c, NULL::BIGINT AS target, NULL::DOUBLE AS wanted FROM pools
      UNION ALL
      SELECT complex, rep, k, list_append(taken, c.pos), c, target, wanted FROM (
        SELECT w.complex, w.rep, t.k, taken, t.target, t.wanted, list_min(list_transform(list_filter(pool, lambda x: NOT list_contains(taken, x.pos)),
          lambda x: struct_pack(error := abs(x.area - t.wanted), h := x.h, pos := x.pos, area := x.area))) AS c
        FROM walk w JOIN targets t ON t.complex = w.complex AND t.k = w.k + 1 JOIN pools p ON p.complex = w.complex AND p.rep = w.rep
        WHERE len(taken) < len(pool)))"""


@query("J18_nearest_matching", sql("residues aa_dim", f"""WITH {POSITION_SQL}, {NEAREST_SQL}
    SELECT complex, rep, target, c.pos AS pos, round(wanted,6)+0.0 AS wanted, round(c.area,6)+0.0 AS area, round(c.error,6)+0.0 AS error FROM walk WHERE k > 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def j18_nearest(spark, sf):
    """Two draws, pair by pair: every interface position with the surface position it is given."""
    pairs = MN.matched_pairs(keep(complexes(spark, sf)), "complex", "area", n_draws=2)
    return rounded(pairs, "wanted", "area", "error")


@query("A38_nearest_null")
def a38_nearest(spark, sf):
    return rounded(MN.nearest_null(keep(complexes(spark, sf)), "complex", "area"), "mean_area_interface", "mean_area_surface", *NULL_RATIOS)


@query("A39_pooled_fit", sql("residues aa_dim", f"""WITH {POSITION_SQL}, e AS (SELECT slope AS y, area AS x1, (region='interface')::INTEGER::DOUBLE AS x2 FROM positions WHERE region <> 'core'),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1,x2) AS s12, covar_pop(x1,y) AS s1y, covar_pop(x2,y) AS s2y, corr(x1,y) AS r FROM e)
    SELECT n, round(r,6)+0.0 AS correlation, round((s1y*s22-s2y*s12)/(s11*s22-s12*s12),6)+0.0 AS coefficient_1, round((s2y*s11-s1y*s12)/(s11*s22-s12*s12),6)+0.0 AS coefficient_2,
      round(my - (s1y*s22-s2y*s12)/(s11*s22-s12*s12)*m1 - (s2y*s11-s1y*s12)/(s11*s22-s12*s12)*m2,6)+0.0 AS intercept FROM m"""))
def a39(spark, sf):
    p = positions(spark, sf).where("region <> 'core'").withColumn("x2", (F.col("region") == "interface").cast("double"))
    return rounded(S.two_term_fit(p, "slope", "area", "x2"), "correlation", "intercept", "coefficient_1", "coefficient_2")
