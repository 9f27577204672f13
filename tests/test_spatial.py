import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrant.operators import matching, matrix, spatial as S, superpose as SP, surface as SA
from titrant.params import RegionParams

COLUMNS = "structure int, chain string, pos int, resname string, atom string, altloc string, element string, x double, y double, z double"


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        x, y, z = (round(float(v), 3) for v in rng.uniform(-8, 8, 3))
        res = ["LYS", "ASP", "ALA", "GLU", "ARG", "GLY"][i % 6]
        rows.append((i % 2, "AB"[i % 4 // 2], i // 4, res, "CA" if i % 3 else "CB", "" if i % 7 else "B", "C", x, y, z))
    return rows


def close(a, b, cutoff):
    return sum((a[k] - b[k]) ** 2 for k in (7, 8, 9)) <= cutoff * cutoff


def test_grid_join_equals_brute_force(spark, cloud):
    df = spark.createDataFrame(cloud, COLUMNS)
    got = S.atom_contacts(df, "A", "B", 5.0).select("structure", "pos", "o_pos").collect()
    kept = [r for r in cloud if r[5] in ("", "A")]
    want = [(a[0], a[2], b[2]) for a, b in itertools.product(kept, kept) if a[0] == b[0] and a[1] == "A" and b[1] == "B" and close(a, b, 5.0)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_cutoff_is_inclusive_across_cells(spark):
    rows = [(0, "A", 0, "LYS", "NZ", "", "N", 4.75, 0.0, 0.0), (0, "B", 0, "ASP", "OD1", "", "O", 9.75, 0.0, 0.0), (0, "B", 1, "ASP", "OD1", "", "O", 9.7501, 0.0, 0.0)]
    got = S.atom_contacts(spark.createDataFrame(rows, COLUMNS), "A", "B", 5.0).collect()
    assert [r.o_pos for r in got] == [0]


def test_many_atom_pairs_are_one_bridge(spark):
    rows = [(0, "A", 0, "ARG", a, "", "N", float(i), 0.0, 0.0) for i, a in enumerate(("NE", "NH1", "NH2"))]
    rows += [(0, "B", 0, "GLU", a, "", "O", float(i), 2.0, 0.0) for i, a in enumerate(("OE1", "OE2"))]
    rows += [(0, "A", 5, "GLU", "OE1", "", "O", 0.5, -2.0, 0.0), (0, "A", 6, "HIS", "ND1", "", "N", 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    r = S.count_bridges(df).first()
    assert (r.n_bridges, r.n_engaged, r.n_cationic, r.n_anionic) == (2, 3, 1, 2)
    assert S.count_bridges(df, cross_chain=True).first().n_bridges == 1


def test_glycine_keeps_its_charge_but_never_pairs(spark):
    rows = [(0, "A", 0, "GLY", "CA", "", "C", 0.0, 0.0, 0.0), (0, "B", 0, "ALA", "CB", "", "C", 1.0, 0.0, 0.0)]
    letters = spark.createDataFrame([(0, "A", 0, "K"), (0, "B", 0, "D")], "structure int, chain string, pos int, aa string")
    r = S.count_threaded(spark.createDataFrame(rows, COLUMNS), letters).first()
    assert (r.n_bridges, r.n_cationic, r.n_anionic) == (0, 1, 1)


def test_scopes_agree_with_separate_counts(spark, cloud):
    df = spark.createDataFrame(cloud, COLUMNS)
    pairs = S.opposite_pairs(S.charged_atoms(df, definition="cbeta_proxy"), 6.0)
    both = {(r.structure, r.scope): (r.n_bridges, r.n_engaged) for r in S.scoped_counts(pairs, S.charged_population(S.signed_residues(df))).collect()}
    for cross, scope in ((False, "all"), (True, "cross_chain")):
        for r in S.count_bridges(df, "cbeta_proxy", cross).collect():
            assert both[(r.structure, scope)] == (r.n_bridges, r.n_engaged)


def test_neutral_pairs_only_touch_the_mean(spark):
    df = spark.createDataFrame([(0, -1.0), (0, 1.0), (0, -1.0), (0, 0.0)], "structure int, product double")
    a, b = S.complementarity(df, "structure").first(), S.complementarity(df, "structure", count_neutral=True).first()
    assert a.sum_product == b.sum_product == -1.0
    assert a.mean_product == pytest.approx(-1 / 3) and b.mean_product == -0.25
    assert (a.n_attractive, a.n_repulsive, a.n_neutral) == (2, 1, 1)


def test_lone_atom_shows_its_whole_sphere(spark):
    df = spark.createDataFrame([(0, "A", 0, "ALA", "CA", "", "C", 0.0, 0.0, 0.0)], COLUMNS)
    area = SA.residue_area(df, ["structure"], ["structure", "chain", "pos"]).first().area
    assert area == pytest.approx(4 * math.pi * 3.1**2)


def test_area_invariants_and_brute_force(spark, cloud):
    df = spark.createDataFrame(cloud, COLUMNS)
    p = RegionParams(sphere_points=40)
    b = SA.burial(df, p).toPandas()
    assert (b.delta >= 0).all() and (b.bound <= b.isolated + 1e-9).all()
    radius = 1.7 + 1.4
    want = {}
    for r in cloud:
        free = 0
        for u in SA.lattice(40):
            q = [r[7 + k] + u[k] * radius for k in range(3)]
            free += not any(o is not r and o[0] == r[0] and sum((q[k] - o[7 + k]) ** 2 for k in range(3)) < radius**2 for o in cloud)
        want[r[:4]] = want.get(r[:4], 0) + free * 4 * math.pi * radius**2 / 40
    for r in b.itertuples():
        assert r.bound == pytest.approx(want[(r.structure, r.chain, r.pos, r.resname)])


def test_agreement_of_sets(spark):
    one = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "g int, pos int")
    two = spark.createDataFrame([(0, i) for i in (2, 3, 4)], "g int, pos int")
    r = SA.agreement(one, two, ["g", "pos"], "g").first()
    assert (r.n_both, r.n_first_only, r.n_second_only, r.jaccard) == (2, 1, 1, 0.5)


def test_only_native_labels_pass(spark):
    df = spark.createDataFrame([("native",), ("predicted",)], "label_source string")
    assert SA.require_native(df.where("label_source = 'native'")).count() == 1
    with pytest.raises(Exception, match="native"):
        SA.require_native(df).collect()
    regions = df.selectExpr("label_source", "1 AS structure", "'core' AS region")
    with pytest.raises(Exception, match="native"):
        SA.require_native(regions).groupBy("structure", "region").count().collect()


def patch(first, second, size=12):
    n = first + second
    m = np.full((n, n), 25.0)
    m[:first, :first] = m[first:, first:] = 3.0
    a, b = slice(first - size, first), slice(first, first + size)
    m[a, b] = m[b, a] = 4.0
    np.fill_diagonal(m, 0.3)
    return m


def test_interface_score_does_not_depend_on_chain_length(spark):
    out = []
    for first, second in ((80, 40), (120, 60)):
        nested = spark.createDataFrame([("j", patch(first, second).tolist())], "job string, pae array<array<double>>")
        out.append(matrix.ipsae(matrix.matrix_rows(nested, "job"), first, second, 10.0).first())
    assert out[0].d0res == pytest.approx(out[1].d0res)
    assert out[0].d0chn != pytest.approx(out[1].d0chn)
    assert out[0]["n_interface_0to1"] == 24


def test_wrong_shape_is_refused(spark):
    nested = spark.createDataFrame([("j", [[1.0, 2.0], [2.0, 1.0]])], "job string, pae array<array<double>>")
    long = matrix.matrix_rows(nested, "job")
    (refused,) = matrix.ipsae(long, 2, 1, 10.0).collect()
    assert refused.problem == "matrix does not fit the chain lengths" and refused.d0res is None
    assert matrix.ipsae(long, 1, 1, 10.0).first().problem is None
    assert matrix.block_means(long, 2, 1).first().interface_pae is None
    assert matrix.block_means(long, 1, 1).first().interface_pae == 2.0


def test_superposition_recovers_a_rigid_move(spark):
    rng = np.random.default_rng(2)
    a = 0.7
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    native, predicted, residues = [], [], []
    for chain in "AB":
        for pos in range(12):
            residues.append((0, chain, pos, "A"))
            for atom in SP.BACKBONE:
                q = rng.uniform(-10, 10, 3)
                native.append((0, chain, pos, atom, *map(float, q)))
                p = turn @ q + [3, -2, 1] + ([0, 0, 0.5] if chain == "A" else [0, 0, 0])
                predicted.append((0, chain, pos, atom, *map(float, p)))
    schema = "structure int, chain string, pos int, atom string, x double, y double, z double"
    n, p = spark.createDataFrame(native, schema), spark.createDataFrame(predicted, schema)
    r = spark.createDataFrame(residues, "structure int, chain string, pos int, aa string")
    pairs = SP.pair_residues(r, r)
    got = SP.interface_rmsd(n, p, pairs, r, "A", "B").first()
    assert got.interface_rmsd == pytest.approx(0.5) and got.superposition_rmsd == pytest.approx(0.0, abs=1e-6)
    few = SP.interface_rmsd(n, p, pairs.where("pos < 5"), r, "A", "B").first()
    assert few.interface_rmsd is None and "too few" in few.note


def test_chain_matching_policies(spark):
    exports = spark.createDataFrame([("one", "ACDE"), ("two", "ACDE"), ("none", "ACDEF"), ("low", "ACDE")], "k string, native_seq string")
    chains = spark.createDataFrame([("one", "A", "ACDE"), ("one", "B", "WWWW"), ("two", "A", "ACDE"), ("two", "B", "ACDE"), ("none", "A", "ACD"), ("low", "A", "ACWW")], "k string, chain_id string, seq string")
    raised = {r.k: r for r in matching.match_chain(exports, chains, ["k"]).collect()}
    assert raised["one"].chain_id == "A" and raised["two"].status == "ambiguous" and raised["two"].chain_id is None
    assert (raised["none"].nearest_chain, raised["none"].nearest_gap) == ("A", -2)
    assert raised["low"].status == "identity too low"
    assert {r.k: r.chain_id for r in matching.match_chain(exports, chains, ["k"], "first").collect()}["two"] == "A"
    assert {r.k: r.chain_id for r in matching.match_chain(exports, chains, ["k"], prefer="B").collect()}["two"] == "B"


def test_packed_bridges_equal_the_joined_ones(spark):
    """Residues that stay in one row per structure are counted like those that meet in joins, without an exchange."""
    from titrant.operators import threading as TH

    rng = np.random.default_rng(11)
    rows = [(k, c, p, "AKDERG"[rng.integers(6)], "CA" if rng.random() < 0.2 else "CB", *(float(v) / 4 for v in rng.integers(-40, 40, 3)))
            for k in range(4) for c in "AB" for p in range(30 if k else 2)]
    rows = [r if r[0] else (*r[:3], "A", *r[4:]) for r in rows]
    df = spark.createDataFrame(rows, "structure int, chain string, pos int, aa string, atom string, x double, y double, z double").withColumn("altloc", F.lit(""))
    cb, signed = S.threaded(df, df.select("structure", "chain", "pos", "aa"))
    want = S.scoped_counts(S.opposite_pairs(cb, 6.0), S.charged_population(signed))
    sign = F.when(F.col("aa").isin("K", "R"), 1).when(F.col("aa").isin("D", "E"), -1)
    at = F.when(F.col("atom") == "CB", F.struct("x", "y", "z"))
    packed = df.groupBy("structure").agg(F.collect_list(F.when(sign.isNotNull(), F.struct("chain", "pos", sign.alias("sign"), at.alias("at")))).alias("residues"))
    got = TH.packed_bridges(packed, ["structure"], 6.0).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("n_bridges > 0").count() > 3


def test_texts_on_backbones_equal_the_joined_residues(spark, monkeypatch):
    """Texts threaded as arrays are counted like residues that meet in joins, and no residue is a row."""
    import itertools

    from titrant.operators import threading as TH
    from titrant.plans import spatial_queries as Q, views as V

    rng = np.random.default_rng(5)
    say = lambda n: "".join("KRDEkAVLx é-"[k] for k in rng.integers(0, 12, n))
    rows = [(k, say(int(rng.integers(1, 60)))) for k in range(-12, 40)] + [(40, say(9)), (40, say(9)), (41, None), (42, "- ."), (43, "V" * 20), (None, say(30)), (45, say(400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    monkeypatch.setattr(V, "table", lambda *_: docs)
    monkeypatch.setattr(TH, "THREADED_BYTES", 300)
    accounts, counts = Q.bridges_on_backbones(spark, None, ["design", "native"])
    old, designs = Q.on_backbones(spark, None)
    assert sorted(map(str, accounts.collect())) == sorted(map(str, old.collect())) and accounts.where("status = 'threaded'").count() > 30
    native = V.backbones(spark, None).join(old.where("status = 'threaded'").select("structure"), "structure", "left_semi")
    first = TH.threaded_letters(designs, old, "structure").select("structure", F.lit("A").alias("chain"), "pos", "aa")
    letters = {"native": native.select(*first.columns)}
    letters["design"] = first.unionByName(letters["native"].where("chain = 'B'"))
    for label, some in letters.items():
        cb, signed = S.threaded(native, some)
        want = S.scoped_counts(S.opposite_pairs(cb, 6.0), S.charged_population(signed))
        got = counts.where(F.col("label") == label).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("n_bridges > 0").count() > 30
    assert not {"posexplode", "transform"} & set(str(accounts._jdf.queryExecution().optimizedPlan()).lower().replace("(", " ").split())
    runs = [(a, a + b) for a, b in itertools.product(range(3), range(3))]
    twos = [*enumerate(itertools.product(runs, runs))]
    df = spark.createDataFrame([(d, *r) for d, two in twos for r in two], "d int, low bigint, high bigint")
    lengths = spark.createDataFrame([(d, sum(b - a + 1 for a, b in two)) for d, two in twos], "d int, n_letters bigint")
    each = df.select("d", F.explode(F.sequence("low", "high")).alias("pos"))
    want = TH.account(lengths.select("d", F.repeat(F.lit("A"), F.col("n_letters").cast("int")).alias("seq")), each, "d").collect()
    assert sorted(map(tuple, TH.account_of_runs(lengths, df, "d").collect())) == sorted(map(tuple, want)) and any(r.status == "threaded" for r in want)


def test_threaded_bridges_read_texts_once(spark, monkeypatch):
    from titrant.plans import spatial_queries as Q, views as V

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.range(20).selectExpr("id AS doc_id", "repeat('KRDE ', int(id) + 2) AS text", "'s' AS source", "'l' AS lang")
    monkeypatch.setattr(V, "table", lambda *_: docs.mapInArrow(counted, docs.schema))
    rows = Q.j13(spark, None).collect()
    assert {r.structure for r in rows} == set(range(20)) and sum(r.n_bridges or 0 for r in rows) > 100
    assert {r.status for r in rows if r.structure % 7 == 3} == {"refused: length differs"} and seen.value == 20


def test_an_account_moves_words_of_positions_and_not_positions(spark):
    from titrant.operators import threading as TH

    designs = spark.createDataFrame([(1, "A" * 1000), (2, "A" * 1000), (3, "A" * 1000)], "d int, seq string")
    places = spark.range(3000).select((F.col("id") % 3 + 1).cast("int").alias("d"), F.floor(F.col("id") / 3).alias("pos"))
    places = places.withColumn("pos", F.when((F.col("d") == 2) & (F.col("pos") == 700), 699).when((F.col("d") == 3) & (F.col("pos") == 0), -1).otherwise(F.col("pos")))
    accounts = TH.account(designs, places, "d")
    assert {r.d: r.status[:7] for r in accounts.collect()} == {1: "threade", 2: "refused", 3: "refused"}
    assert "count(distinct" not in accounts._jdf.queryExecution().optimizedPlan().toString().lower()


def test_every_point_is_copied_to_eight_cells(spark):
    """Also where it or its partner stands on the side of a cell; each pair at the reach appears once."""
    reach = 3.0
    side = 2 * reach * 1.000001
    rng = np.random.default_rng(3)
    xs = [k * side + d for k in (-2, 0, 1) for d in (0.0, reach, -reach, reach * 1e-6)]
    points = [(0, i, *(float(v) for v in rng.choice(xs, 3))) for i in range(80)]
    df = spark.createDataFrame(points, "s int, i int, x double, y double, z double")
    assert S.with_near_cells(df, reach).groupBy("i").count().where("count <> 8").isEmpty()
    got = S.grid_join(df, df.withColumnRenamed("i", "j"), reach, ["s"]).select("i", "j").collect()
    want = [(a[1], b[1]) for a, b in itertools.product(points, points) if sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= reach * reach]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > len(points)
