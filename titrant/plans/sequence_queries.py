"""Sequence features, region partitions, reconciliation."""

from pyspark.sql import functions as F

from titrant import constants as K
from titrant.functions import bridge, charge as Q, hydropathy as H, text as T
from titrant.functions.identity import identity, mutations
from titrant.operators import regions as R
from titrant.operators.joins import measured
from titrant.operators.reconcile import candidate_errors, reconcile
from titrant.operators.sequence_checks import bad_letters
from titrant.params import ChargeParams
from titrant.plans import views as V
from titrant.plans.registry import query
from titrant.plans.view_sql import sql


def r6(c):
    """Rounded, with minus zero turned into zero."""
    return F.round(c, 6) + F.lit(0.0)


TERM = "(CASE WHEN pos = 0 THEN 1/(1+pow(10::DOUBLE, 7.4-8.6)) ELSE 0 END + CASE WHEN pos = n-1 THEN -1/(1+pow(10::DOUBLE, 3.6-7.4)) ELSE 0 END)"


@query("F01_residue_charge_simple", sql("residues aa_dim", """
    SELECT doc_id, aa, q::BIGINT AS q, count(*) AS n_residues, sum(pos)::BIGINT AS pos_sum
    FROM residues JOIN aa_dim USING (aa) WHERE q <> 0 GROUP BY ALL"""))
def f01(spark, sf):
    long = V.residues(spark, sf).withColumn("q", Q.residue_charge_simple(F.col("aa")).cast("bigint"))
    return long.where("q <> 0").groupBy("doc_id", "aa", "q").agg(
        F.count(F.lit(1)).alias("n_residues"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


@query("F02_net_charge_simple", sql("residues aa_dim", """
    SELECT doc_id, sum(q)::BIGINT AS net_charge FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id"""))
def f02(spark, sf):
    return V.seqs(spark, sf).select("doc_id", Q.net_charge_simple(F.col("seq")).cast("bigint").alias("net_charge"))


@query("F03_side_chain_charge", sql("residues aa_dim", """
    SELECT aa, count(*) AS n_residues, round(any_value(qph),9)+0.0 AS q FROM residues JOIN aa_dim USING (aa) GROUP BY aa"""))
def f03(spark, sf):
    return V.residues(spark, sf).groupBy("aa").agg(F.count(F.lit(1)).alias("n_residues")).withColumn(
        "q", F.round(Q.side_chain_charge(F.col("aa")), 9) + F.lit(0.0))


@query("F04_residue_charge_ph", sql("residues aa_dim", f"""
    SELECT doc_id, round(sum(qph + {TERM}),6)+0.0 AS total, round(max(qph + {TERM}),6)+0.0 AS top,
      round(min(qph + {TERM}),6)+0.0 AS bottom, round(max(CASE WHEN pos=0 THEN qph + {TERM} END),6)+0.0 AS first_residue,
      round(max(CASE WHEN pos=n-1 THEN qph + {TERM} END),6)+0.0 AS last_residue
    FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id"""))
def f04(spark, sf):
    q = Q.residue_charge_ph(F.col("aa"), F.col("pos"), F.col("n"))
    long = V.residues(spark, sf).withColumn("q", q)
    return long.groupBy("doc_id").agg(
        r6(F.sum("q")).alias("total"), r6(F.max("q")).alias("top"), r6(F.min("q")).alias("bottom"),
        r6(F.max(F.when(F.col("pos") == 0, F.col("q")))).alias("first_residue"),
        r6(F.max(F.when(F.col("pos") == F.col("n") - 1, F.col("q")))).alias("last_residue"))


@query("F05_net_charge_ph", sql("residues aa_dim", f"""
    SELECT doc_id, round(sum(qph + {TERM}),6)+0.0 AS with_termini, round(sum(qph),6)+0.0 AS no_termini,
      round(sum(CASE WHEN aa IN ('C','Y') THEN 0 ELSE qph END + {TERM}),6)+0.0 AS no_cys_tyr
    FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id"""))
def f05(spark, sf):
    s = F.col("seq")
    return V.seqs(spark, sf).select(
        "doc_id", r6(Q.net_charge_ph(s)).alias("with_termini"),
        r6(Q.net_charge_ph(s, ChargeParams(termini=False))).alias("no_termini"),
        r6(Q.net_charge_ph(s, ChargeParams(cys_tyr=False))).alias("no_cys_tyr"))


PARTITION_SQL = f"""parts AS (SELECT doc_id, source, lang, beta,
      count(*) FILTER (WHERE region='interface') AS n_residues_interface,
      count(*) FILTER (WHERE region='surface') AS n_residues_surface,
      count(*) FILTER (WHERE region='core') AS n_residues_core, count(*) AS n_residues_total,
      sum(CASE WHEN region='interface' THEN q ELSE 0 END)::BIGINT AS charge_interface_simple,
      sum(CASE WHEN region='surface' THEN q ELSE 0 END)::BIGINT AS charge_surface_simple,
      sum(CASE WHEN region='core' THEN q ELSE 0 END)::BIGINT AS charge_core_simple,
      sum(q)::BIGINT AS charge_total_simple,
      sum(CASE WHEN region='interface' THEN qph+{TERM} ELSE 0 END) AS charge_interface_ph7_4_emboss,
      sum(CASE WHEN region='surface' THEN qph+{TERM} ELSE 0 END) AS charge_surface_ph7_4_emboss,
      sum(CASE WHEN region='core' THEN qph+{TERM} ELSE 0 END) AS charge_core_ph7_4_emboss,
      sum(qph+{TERM}) AS charge_total_ph7_4_emboss
    FROM residues JOIN aa_dim USING (aa) GROUP BY ALL)"""
TAG = "ph7_4_emboss"
LABELS = ("doc_id", "source", "lang", "beta")


def partitions(spark, sf):
    return R.partition_charge(V.residues(spark, sf), LABELS)


@query("F06_charge_density", sql("residues aa_dim", f"""WITH {PARTITION_SQL}
    SELECT doc_id, coalesce(round(charge_interface_simple/nullif(n_residues_interface,0),6),0)+0.0 AS density_interface,
      coalesce(round(charge_surface_simple/nullif(n_residues_surface,0),6),0)+0.0 AS density_surface,
      coalesce(round(charge_core_simple/nullif(n_residues_core,0),6),0)+0.0 AS density_core FROM parts"""))
def f06(spark, sf):
    return R.density_simple(partitions(spark, sf)).select(
        "doc_id", *[r6(F.col(f"density_{r}")).alias(f"density_{r}") for r in R.REGIONS])


@query("F07_mean_scaled_hydropathy", sql("residues aa_dim", """
    SELECT doc_id, round(avg((kd+4.5)/9.0),6)+0.0 AS hydropathy FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id"""))
def f07(spark, sf):
    return V.seqs(spark, sf).select("doc_id", r6(H.mean_scaled_hydropathy(F.col("seq"))).alias("hydropathy"))


@query("F08_mean_net_charge", sql("residues aa_dim", """
    SELECT doc_id, abs(sum(q))::BIGINT / count(*) AS mean_net_charge FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id"""))
def f08(spark, sf):
    return V.seqs(spark, sf).select("doc_id", H.mean_net_charge(F.col("seq")).alias("mean_net_charge"))


DIAGRAM_SQL = """diagram AS (SELECT *, mean_net_charge - boundary AS distance_from_boundary, mean_net_charge - boundary > 0 AS predicted_disordered
    FROM (SELECT *, 2.785*mean_scaled_hydropathy - 1.151 AS boundary FROM (
      SELECT doc_id, beta, avg((kd+4.5)/9.0) AS mean_scaled_hydropathy, abs(sum(q))::BIGINT / count(*) AS mean_net_charge,
        sum(q)::BIGINT AS signed_net_charge, count(*) AS n_residues
      FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id, beta)))"""


@query("F09_boundary_distance", sql("residues aa_dim", f"""WITH {DIAGRAM_SQL}
    SELECT doc_id, round(boundary,6)+0.0 AS boundary, round(distance_from_boundary,6)+0.0 AS distance, predicted_disordered FROM diagram"""))
def f09(spark, sf):
    return H.place_on_diagram(V.seqs(spark, sf)).select(
        "doc_id", r6(F.col("boundary")).alias("boundary"),
        r6(F.col("distance_from_boundary")).alias("distance"), "predicted_disordered")


@query("F10_diagram_point", sql("residues aa_dim", f"""WITH {DIAGRAM_SQL}
    SELECT doc_id, round(mean_scaled_hydropathy,6)+0.0 AS mean_scaled_hydropathy, round(mean_net_charge,6)+0.0 AS mean_net_charge,
      signed_net_charge, n_residues, round(boundary,6)+0.0 AS boundary,
      round(distance_from_boundary,6)+0.0 AS distance_from_boundary, predicted_disordered FROM diagram"""))
def f10(spark, sf):
    return H.place_on_diagram(V.seqs(spark, sf)).select(
        "doc_id", r6(F.col("mean_scaled_hydropathy")).alias("mean_scaled_hydropathy"),
        r6(F.col("mean_net_charge")).alias("mean_net_charge"),
        F.col("signed_net_charge").cast("bigint").alias("signed_net_charge"),
        F.col("n_residues").cast("bigint").alias("n_residues"), r6(F.col("boundary")).alias("boundary"),
        r6(F.col("distance_from_boundary")).alias("distance_from_boundary"), "predicted_disordered")


IDENTITY_SQL = """WITH letters AS (SELECT doc_id, source, lang, n, pos, aa FROM residues),
    nat AS (SELECT source, lang, native_id, length(native_seq) AS native_n FROM natives),
    rev AS (SELECT a.doc_id, count(*) FILTER (WHERE a.aa = b.aa) AS hits FROM letters a JOIN letters b
       ON a.doc_id = b.doc_id AND b.pos = a.n - 1 - a.pos GROUP BY a.doc_id),
    to_nat AS (SELECT a.doc_id, count(*) FILTER (WHERE a.aa = b.aa) AS hits FROM letters a JOIN nat USING (source, lang)
       JOIN letters b ON b.doc_id = nat.native_id AND b.pos = a.pos WHERE a.n = nat.native_n GROUP BY a.doc_id)"""


@query("F15_identity", sql("residues natives", IDENTITY_SQL + """
    SELECT s.doc_id, rev.hits/length(s.seq) AS to_reverse, coalesce(to_nat.hits/length(s.seq), 0)::DOUBLE AS to_native
    FROM seqs s JOIN rev USING (doc_id) LEFT JOIN to_nat USING (doc_id)"""))
def f15(spark, sf):
    s = V.seqs(spark, sf)
    return s.join(measured(V.natives(s)), ["source", "lang"]).select(
        "doc_id", identity(F.col("seq"), F.reverse("seq")).alias("to_reverse"),
        identity(F.col("seq"), F.col("native_seq")).alias("to_native"))


@query("F16_mutation_count", sql("residues natives", IDENTITY_SQL + """
    SELECT s.doc_id, length(s.seq) - rev.hits AS from_reverse, length(s.seq) - to_nat.hits AS from_native
    FROM seqs s JOIN rev USING (doc_id) LEFT JOIN to_nat USING (doc_id)"""))
def f16(spark, sf):
    s = V.seqs(spark, sf)
    return s.join(measured(V.natives(s)), ["source", "lang"]).select(
        "doc_id", mutations(F.col("seq"), F.reverse("seq")).alias("from_reverse"),
        mutations(F.col("seq"), F.col("native_seq")).alias("from_native"))


@query("F17_charged_composition", sql("residues", """
    SELECT doc_id, count(*) FILTER (WHERE aa IN ('K','R')) AS n_cationic, count(*) FILTER (WHERE aa IN ('D','E')) AS n_anionic,
      count(*) FILTER (WHERE aa IN ('K','R','D','E')) AS n_charged, count(*) AS n_residues,
      count(*) FILTER (WHERE aa IN ('K','R')) * count(*) FILTER (WHERE aa IN ('D','E')) AS n_opportunities,
      count(*) FILTER (WHERE aa IN ('K','R','H')) AS n_cationic_with_histidine FROM residues GROUP BY doc_id"""))
def f17(spark, sf):
    out = bridge.composition(V.seqs(spark, sf))
    return out.select(
        "doc_id", "n_cationic", "n_anionic", "n_charged", "n_residues", "n_opportunities",
        Q.count_letters(F.col("seq"), "KRH").cast("bigint").alias("n_cationic_with_histidine"))


@query("F20_residue_labels", sql("atoms", """
    SELECT DISTINCT structure, chain||pos::VARCHAR AS label, chain||':'||pos::VARCHAR||':' AS id_text FROM atoms"""))
def f20(spark, sf):
    a = V.atoms(spark, sf).select("structure", "chain", "pos").distinct()
    icode = F.lit(" ")
    return a.select("structure", T.residue_label(F.col("chain"), F.col("pos"), icode).alias("label"),
                    T.residue_id_text(F.col("chain"), F.col("pos"), icode).alias("id_text"))


@query("F21_decode_indices", sql("seqs", """
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE md5(seq) END AS decoded_md5 FROM seqs"""))
def f21(spark, sf):
    codes = F.transform(F.split("seq", ""), lambda a: F.instr(F.lit(K.ALPHABET), a) - 1)
    spoiled = F.when(F.col("doc_id") % 10 == 0, F.array_append(codes, F.lit(20))).otherwise(codes)
    return V.seqs(spark, sf).select(
        "doc_id", F.md5(T.decode_indices(spoiled).cast("binary")).alias("decoded_md5"))


@query("F22_dose_tag", sql("seqs", """
    SELECT beta, replace(replace(replace(printf('%+.1f', beta),'+','p'),'-','m'),'.','_') AS tag, count(*) AS n FROM seqs GROUP BY ALL"""))
def f22(spark, sf):
    return V.seqs(spark, sf).groupBy("beta", T.dose_tag(F.col("beta")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("F23_nested_access", """
    SELECT event_id, json_extract(props,'$.k')::BIGINT AS k,
      CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END::BIGINT AS weight,
      json_extract(props,'$.k')::BIGINT IN (5, 25, 69) AS listed FROM events""")
def f23(spark, sf):
    weights = F.create_map(*[F.lit(v) for pair in (("click", 1), ("view", 2), ("purchase", 3)) for v in pair])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return V.table(spark, sf, "events").select(
        "event_id", k.alias("k"), F.try_element_at(weights, F.col("event_type")).cast("bigint").alias("weight"),
        F.array_contains(F.array(F.lit(5), F.lit(25), F.lit(69)).cast("array<bigint>"), k).alias("listed"))


@query("A01_region_partition", sql("residues aa_dim", f"""WITH {PARTITION_SQL}
    SELECT doc_id, n_residues_interface, n_residues_surface, n_residues_core, n_residues_total,
      charge_interface_simple, charge_surface_simple, charge_core_simple, charge_total_simple,
      round(charge_interface_{TAG},6)+0.0 AS interface_ph, round(charge_surface_{TAG},6)+0.0 AS surface_ph,
      round(charge_core_{TAG},6)+0.0 AS core_ph, round(charge_total_{TAG},6)+0.0 AS total_ph FROM parts"""))
def a01(spark, sf):
    p = partitions(spark, sf)
    return p.select(
        "doc_id", *[f"n_residues_{r}" for r in (*R.REGIONS, "total")],
        *[f"charge_{r}_simple" for r in (*R.REGIONS, "total")],
        *[r6(F.col(f"charge_{r}_{TAG}")).alias(f"{r}_ph") for r in (*R.REGIONS, "total")])


@query("P13_tagged_columns", sql("residues aa_dim", f"""WITH {PARTITION_SQL}
    SELECT doc_id, charge_total_simple, round(charge_total_{TAG},6)+0.0 AS charge_total_{TAG} FROM parts"""))
def p13(spark, sf):
    names = [f"charge_total_{Q.definition_tag(d)}" for d in ("simple", "ph")]
    p = partitions(spark, sf)
    return p.select("doc_id", names[0], r6(F.col(names[1])).alias(names[1]))


def shifts(spark, sf):
    table = partitions(spark, sf)
    s = V.seqs(spark, sf)
    first = V.natives(s).select(
        "source", "lang", F.length("native_seq").alias("n"),
        F.posexplode(F.split("native_seq", "")).alias("pos", "aa"))
    native = R.partition_charge(first.withColumn("region", V.region_label(F.col("pos"))), ["source", "lang"])
    return R.shift_from(table, native, ["source", "lang"], ["simple", TAG])


SHIFT_SQL = f"""{PARTITION_SQL}, firsts AS (SELECT p.* FROM parts p JOIN natives n ON p.doc_id = n.native_id),
    shifts AS (SELECT p.doc_id, p.source, p.lang, p.beta, """ + ", ".join(
    f"p.charge_{r}_{d} - f.charge_{r}_{d} AS charge_shift_{r}_{d}"
    for d in ("simple", TAG) for r in (*R.REGIONS, "total")) + """
    FROM parts p JOIN firsts f USING (source, lang))"""


@query("A02_shift_from_native", sql("residues natives aa_dim", f"""WITH {SHIFT_SQL}
    SELECT doc_id, charge_shift_interface_simple, charge_shift_surface_simple, charge_shift_core_simple, charge_shift_total_simple,
      round(charge_shift_total_{TAG},6)+0.0 AS total_ph FROM shifts"""))
def a02(spark, sf):
    return shifts(spark, sf).select(
        "doc_id", *[f"charge_shift_{r}_simple" for r in (*R.REGIONS, "total")],
        r6(F.col(f"charge_shift_total_{TAG}")).alias("total_ph"))


@query("P14_definitions_by_prefix", sql("residues natives aa_dim", f"""WITH {SHIFT_SQL}
    SELECT 'simple' AS definition, count(*) AS n, round(sum(charge_shift_total_simple)::DOUBLE,6)+0.0 AS total, round(sum(charge_shift_interface_simple)::DOUBLE,6)+0.0 AS interface FROM shifts
    UNION ALL SELECT '{TAG}', count(*), round(sum(charge_shift_total_{TAG}),6)+0.0, round(sum(charge_shift_interface_{TAG}),6)+0.0 FROM shifts"""))
def p14(spark, sf):
    long = R.by_definition(shifts(spark, sf), ["doc_id"])
    return long.groupBy("definition").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("shift_total")).alias("total"), r6(F.sum("shift_interface")).alias("interface"))


@query("A03_region_counts", sql("residues", """
    SELECT doc_id, count(*) FILTER (WHERE region='interface') AS interface, count(*) FILTER (WHERE region='surface') AS surface,
      count(*) FILTER (WHERE region='core') AS core FROM residues GROUP BY doc_id"""))
def a03(spark, sf):
    return R.region_counts(V.residues(spark, sf), ["doc_id"])


@query("U01_surface_by_subtraction", sql("residues", """
    SELECT doc_id, count(*) AS n_surface, sum(pos)::BIGINT AS pos_sum FROM residues
    WHERE region = 'surface' GROUP BY doc_id"""))
def u01(spark, sf):
    n = F.length("seq")
    every = F.sequence(F.lit(0), n - 1)
    interface = F.filter(every, lambda p: p % 4 == 0)
    core = F.filter(every, lambda p: p % 4 == 1)
    s = V.seqs(spark, sf).select("doc_id", R.surface_positions(n, interface, core).alias("left"))
    s = s.select("doc_id", F.explode("left").alias("pos"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_surface"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


def reported(spark, sf):
    """A reported charge that differs from the simple count by a known offset."""
    return V.seqs(spark, sf).withColumn(
        "reported", Q.net_charge_simple(F.col("seq")) + (F.col("doc_id") % 3 - 1) * 0.4)


def _candidate_sql():
    term = lambda ph, n, c: f"(CASE WHEN pos=0 THEN 1/(1+pow(10::DOUBLE,{ph}-{n})) ELSE 0 END + CASE WHEN pos=n-1 THEN -1/(1+pow(10::DOUBLE,{c}-{ph})) ELSE 0 END)"
    side = lambda ph, p: f"(CASE WHEN aa IN ('K','R','H') THEN 1/(1+pow(10::DOUBLE,{ph}-{p})) WHEN aa IN ('D','E','C','Y') THEN -1/(1+pow(10::DOUBLE,{p}-{ph})) ELSE 0 END)"
    e, b = ("8.6", "3.6"), ("7.5", "3.55")
    exprs = {
        "simple_KR_minus_DE": "sum(q)::DOUBLE",
        "ph7.4_emboss": f"sum({side('7.4','pka_e')}+{term('7.4',*e)})",
        "ph7.4_bjellqvist": f"sum({side('7.4','pka_b')}+{term('7.4',*b)})",
        "ph7.4_emboss_no_termini": f"sum({side('7.4','pka_e')})",
        "ph7.4_emboss_no_cys_tyr": f"sum(CASE WHEN aa IN ('C','Y') THEN 0 ELSE {side('7.4','pka_e')} END+{term('7.4',*e)})",
        "ph7.0_emboss": f"sum({side('7.0','pka_e')}+{term('7.0',*e)})",
        "ph7.0_bjellqvist": f"sum({side('7.0','pka_b')}+{term('7.0',*b)})",
    }
    cols = ", ".join(f'{x} AS "{k}"' for k, x in exprs.items())
    names = ", ".join(f'"{k}"' for k in exprs)
    return f"""wide AS (SELECT doc_id, sum(q) + (doc_id % 3 - 1)*0.4::DOUBLE AS reported, {cols} FROM residues JOIN aa_dim USING (aa) GROUP BY doc_id),
      long AS (SELECT definition, computed, computed - reported AS error FROM (UNPIVOT wide ON {names} INTO NAME definition VALUE computed))"""


@query("A28_reconcile_definitions", sql("residues aa_dim", f"""WITH {_candidate_sql()}
    SELECT definition, round(avg(abs(error)),6)+0.0 AS mean_absolute_error, round(quantile_cont(abs(error),0.5),6)+0.0 AS median_absolute_error,
      round(max(abs(error)),6)+0.0 AS max_absolute_error, round(avg(error),6)+0.0 AS mean_signed_error,
      round(avg(CASE WHEN abs(error) <= 0.51 THEN 1 ELSE 0 END),6)+0.0 AS fraction_within_tolerance, count(*) AS n_designs FROM long GROUP BY definition"""))
def a28(spark, sf):
    out = reconcile(reported(spark, sf), "seq", "reported")
    stats = ("mean_absolute_error", "median_absolute_error", "max_absolute_error", "mean_signed_error", "fraction_within_tolerance")
    return out.select("definition", *[r6(F.col(c)).alias(c) for c in stats], "n_designs")


@query("W09_best_by_metric", sql("residues aa_dim", f"""WITH {_candidate_sql()}
    SELECT definition, round(avg(abs(error)),6)+0.0 AS mean_absolute_error FROM long GROUP BY definition ORDER BY avg(abs(error)), definition LIMIT 1"""))
def w09(spark, sf):
    return reconcile(reported(spark, sf), "seq", "reported").select(
        "definition", r6(F.col("mean_absolute_error")).alias("mean_absolute_error")).limit(1)


@query("X03_candidate_functions", sql("residues aa_dim", f"""WITH {_candidate_sql()}
    SELECT definition, round(avg(computed),6)+0.0 AS mean_charge, round(min(computed),6)+0.0 AS lowest, round(max(computed),6)+0.0 AS highest FROM long GROUP BY definition"""))
def x03(spark, sf):
    long = candidate_errors(reported(spark, sf), "seq", "reported")
    return long.groupBy("definition").agg(
        r6(F.avg("computed")).alias("mean_charge"), r6(F.min("computed")).alias("lowest"), r6(F.max("computed")).alias("highest"))


@query("A40_diagram_by_dose", sql("residues aa_dim", f"""WITH {DIAGRAM_SQL}
    SELECT beta, count(*) AS n, round(avg(mean_scaled_hydropathy),6)+0.0 AS mean_hydropathy, round(avg(mean_net_charge),6)+0.0 AS mean_net_charge,
      round(avg(distance_from_boundary),6)+0.0 AS mean_distance, round(avg(predicted_disordered::INTEGER),6)+0.0 AS fraction_disordered FROM diagram GROUP BY beta"""))
def a40(spark, sf):
    d = H.place_on_diagram(V.seqs(spark, sf))
    return d.groupBy("beta").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("mean_scaled_hydropathy")).alias("mean_hydropathy"),
        r6(F.avg("mean_net_charge")).alias("mean_net_charge"), r6(F.avg("distance_from_boundary")).alias("mean_distance"),
        r6(F.avg(F.col("predicted_disordered").cast("int"))).alias("fraction_disordered"))


@query("A43_sign_split", sql("residues aa_dim", f"""WITH {DIAGRAM_SQL}
    SELECT sign(signed_net_charge)::BIGINT AS direction, count(*) AS n, round(avg(distance_from_boundary),6)+0.0 AS mean_distance FROM diagram GROUP BY ALL"""))
def a43(spark, sf):
    d = H.place_on_diagram(V.seqs(spark, sf))
    return d.groupBy(F.signum("signed_net_charge").cast("bigint").alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("distance_from_boundary")).alias("mean_distance"))


@query("V16_bad_letters", sql("", """
    WITH raw AS (SELECT doc_id, upper(regexp_replace(text,'[^A-Za-z]','','g')) AS seq FROM documents),
    chars AS (SELECT doc_id, unnest(string_split(seq,'')) AS letter, unnest(range(length(seq))) AS pos FROM raw),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, letter ORDER BY pos) AS r FROM chars WHERE letter NOT IN
      ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y',''))
    SELECT doc_id, letter, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ranked WHERE r <= 5 GROUP BY ALL"""))
def v16(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return bad_letters(docs, "doc_id", "seq")


@query("P15_job_key", sql("seqs", """
    SELECT doc_id, source||'_A_beta'||replace(replace(replace(printf('%+.4f', beta),'+','p'),'-','m'),'.','_')||'_rep'||(doc_id % 3)::VARCHAR AS key FROM seqs"""))
def p15(spark, sf):
    return V.seqs(spark, sf).select(
        "doc_id", T.job_key(F.col("source"), F.lit("A"), F.col("beta"), F.col("doc_id") % 3).alias("key"))


@query("P16_row_seed", sql("seqs", """
    SELECT doc_id, ('0x'||substr(sha256('7|'||source||'|'||printf('%.6f', beta)||'|'||(doc_id % 3)::VARCHAR),1,8))::BIGINT AS seed FROM seqs"""))
def p16(spark, sf):
    return V.seqs(spark, sf).select(
        "doc_id", T.row_seed(7, F.col("source"), F.col("beta"), F.col("doc_id") % 3).alias("seed"))
