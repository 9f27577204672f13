import math

import pytest
from pyspark.sql import functions as F

from titrant.functions import bridge, charge as Q, hydropathy as H, score, text as T
from titrant.functions.identity import identity, mutations
from titrant.params import ChargeParams


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_net_simple_charge(spark):
    cases = {"KRDE": 0, "KKKK": 4, "DDEE": -4, "H": 0, "KRRKK": 5, "DEDED": -5, "MKVLAAGIVGLLLLLAAYCYA": 1}
    got = values(spark, [(s,) for s in cases], "s string", Q.net_charge_simple(F.col("s")))
    assert [g[0] for g in got] == list(cases.values())


@pytest.mark.parametrize("letter,pka,sign", [("K", 10.8, 0.5), ("R", 12.5, 0.5), ("H", 6.5, 0.5), ("D", 3.9, -0.5), ("E", 4.1, -0.5), ("C", 8.5, -0.5), ("Y", 10.1, -0.5)])
def test_half_charge_at_the_pka(spark, letter, pka, sign):
    p = ChargeParams(ph=pka, termini=False)
    assert values(spark, [(letter,)], "s string", Q.net_charge_ph(F.col("s"), p))[0][0] == pytest.approx(sign)


def test_ph_charge_of_neutral_and_histidine(spark):
    p = ChargeParams(termini=False)
    got = values(spark, [("AAAGGGVVV",), ("H" * 20,)], "s string", Q.net_charge_ph(F.col("s"), p), Q.net_charge_simple(F.col("s")))
    assert got[0] == (0.0, 0)
    assert got[1][0] > 1.0 and got[1][1] == 0


def test_cys_tyr_switch_only_removes_those(spark):
    on, off = ChargeParams(), ChargeParams(cys_tyr=False)
    got = values(spark, [("KDE",), ("KDECY",)], "s string", Q.net_charge_ph(F.col("s"), on), Q.net_charge_ph(F.col("s"), off))
    assert got[0][0] == pytest.approx(got[0][1])
    assert got[1][0] < got[1][1]


def test_composition(spark):
    rows = bridge.composition(spark.createDataFrame([("KKRRDDEEAAA",)], "seq string")).first()
    assert (rows.n_cationic, rows.n_anionic, rows.n_charged, rows.n_opportunities, rows.n_residues) == (4, 4, 8, 16, 11)
    khhd = spark.createDataFrame([("KHHD",)], "seq string")
    assert bridge.composition(khhd).first().n_cationic == 1
    assert bridge.composition(khhd, histidine=True).first().n_cationic == 3


def test_diagram(spark):
    rows = H.place_on_diagram(spark.createDataFrame([("A" * 40,), ("K" * 40,)], "seq string")).collect()
    assert rows[0].mean_net_charge == 0 and not rows[0].predicted_disordered
    assert rows[1].mean_net_charge == 1 and rows[1].predicted_disordered
    line = values(spark, [(0.0,), (1.0,)], "h double", H.boundary_charge(F.col("h")))
    assert line[0][0] == pytest.approx(-1.151) and line[1][0] == pytest.approx(1.634)


def test_length_normalisations_differ_on_purpose(spark):
    got = values(spark, [(27.0,), (5.0,), (200.0,), (10.0,), (26.0,)], "n double", score.d0_scalar(F.col("n")), score.d0_array(F.col("n")))
    assert got[0][0] == 1 and got[1][0] == 1
    assert got[2][0] == pytest.approx(1.24 * 185 ** (1 / 3) - 1.8)
    assert got[3][1] == got[4][1]
    assert got[0][1] != got[0][0]


def test_identity_and_mutations(spark):
    got = values(spark, [("ACDE", "ACDF"), ("ACD", "ACDF"), ("", "")], "a string, b string", identity(F.col("a"), F.col("b")), mutations(F.col("a"), F.col("b")))
    assert got[0] == (0.75, 1)
    assert got[1] == (0.0, None)
    assert got[2][0] == 0.0


def test_names_and_seeds(spark):
    import hashlib

    got = values(spark, [("1ABC", "A", -1.5, 2)], "e string, c string, b double, r int", T.dose_tag(F.col("b")),
                 T.job_key(F.col("e"), F.col("c"), F.col("b"), F.col("r")), T.row_seed(7, F.col("e"), F.col("b"), F.col("r")))[0]
    seed = int.from_bytes(hashlib.sha256(b"7|1ABC|-1.500000|2").digest()[:4], "big")
    assert got == ("m1_5", "1ABC_A_betam1_5000_rep2", seed)


def test_decode_refuses_unknown_codes(spark):
    got = values(spark, [([0, 1, 19],), ([0, 20],), ([-1],)], "i array<int>", T.decode_indices(F.col("i")))
    assert got == [("ACY",), (None,), (None,)]


def test_composition_status(spark):
    got = values(spark, [(40, 38), (60, 40), (0, 5)], "l int, r int", bridge.composition_status(F.col("l"), F.col("r")))
    assert [g[0] for g in got] == ["ok", "unmatched", "no_charge"]


def test_area_of_zero_is_refused(spark):
    t = spark.createDataFrame([(6, 10, 20, 4, 0.0), (6, 10, 0, 4, 500.0)], "n_bridges int, n_charged int, n_opportunities int, n_engaged int, area double")
    bad, good = bridge.normalised(t, "area").collect()
    assert bad.per_1000_area is None and bad.area_error
    assert good.per_1000_area == 12.0 and good.per_opportunity == 0.0 and good.area_error is None


def test_regions_add_up(spark):
    from titrant.operators.regions import partition_charge

    seq = "MKDERHCYKKAD"
    rows = [(i, a, len(seq), ("interface", "core", "surface")[i % 3]) for i, a in enumerate(seq)]
    r = partition_charge(spark.createDataFrame(rows, "pos int, aa string, n int, region string").withColumn("k", F.lit(1)), ["k"]).first()
    assert r.charge_interface_simple + r.charge_surface_simple + r.charge_core_simple == r.charge_total_simple
    parts = r.charge_interface_ph7_4_emboss + r.charge_surface_ph7_4_emboss + r.charge_core_ph7_4_emboss
    whole = spark.createDataFrame([(seq,)], "s string").select(Q.net_charge_ph(F.col("s"))).first()[0]
    assert math.isclose(parts, r.charge_total_ph7_4_emboss) and math.isclose(parts, whole)


def test_letters_are_counted_without_translate(spark):
    from titrant.functions.charge import count_letters

    rows = [("KKRDé",), ("",), (None,), ("xyzK",)]
    df = spark.createDataFrame(rows, "s string").select("s", count_letters(F.col("s"), "KRK").alias("n"), count_letters(F.col("s"), "éK").alias("m"))
    assert [(r.n, r.m) for r in df.collect()] == [(3, 3), (0, 0), (None, None), (1, 1)]
    assert "translate" not in df._jdf.queryExecution().optimizedPlan().toString()
