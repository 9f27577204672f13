import numpy as np
import pytest
from pyspark.sql import functions as F

from titrant.operators import membership as M, ordering as O, pairing as P, readings as RD, resample as B, slopes as S
from titrant.operators.regions import REGIONS

DOSES = [-3.0, -1.5, 0.0, 1.5, 3.0]
KEYS = ["entry", "chain", "replicate"]


@pytest.fixture
def grid(spark):
    rows = [(f"complex{i}", "A", 0, b, 10.0 * i + 0.8 - 0.1 * abs(b)) for i in range(5) for b in DOSES]
    return spark.createDataFrame(rows, "entry string, chain string, replicate int, beta double, ptm double")


def test_identical_and_shifted_pairs(spark):
    rows = [(i, v, v, v - 2.0) for i, v in enumerate([1.0, 5.0, 9.0, 2.0, 7.0])]
    df = spark.createDataFrame(rows, "u int, a double, b double, c double")
    same = B.paired_interval(df, [], "a", "b", "u", n_resamples=200).first()
    assert (same.estimate, same.low, same.high, same.excludes_zero) == (0.0, 0.0, 0.0, False)
    off = B.paired_interval(df, [], "a", "c", "u", n_resamples=200).first()
    assert (off.estimate, off.low, off.excludes_zero, off.n) == (2.0, 2.0, True, 5)


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    df = spark.range(60).select(F.col("id").alias("u"), (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    run = lambda d: sorted(tuple(r) for r in B.bootstrap_interval(d, ["g"], "v", "u", n_resamples=100, seed=4).collect())
    assert run(df.repartition(1)) == run(df.repartition(7))


def test_bootstrap_covers_like_the_textbook(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(3.0, 1.0, 80)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "u int, v double")
    got = B.bootstrap_interval(df, [], "v", "u", n_resamples=1000).first()
    reps = v[rng.integers(0, 80, (4000, 80))].mean(axis=1)
    assert got.estimate == pytest.approx(v.mean())
    assert got.low == pytest.approx(np.quantile(reps, 0.025), abs=0.04)
    assert got.high == pytest.approx(np.quantile(reps, 0.975), abs=0.04)


def test_shuffle_join_gives_what_the_broadcast_gave(spark, monkeypatch):
    df = spark.range(40).select(F.col("id").alias("u"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    a = B.bootstrap_interval(df, [], "v", "u", n_resamples=50).first()
    monkeypatch.setattr(B, "BROADCAST_UNITS", 0)
    assert B.bootstrap_interval(df, [], "v", "u", n_resamples=50).first() == a


def test_spearman_with_ties_and_guards(spark):
    import pandas as pd

    x, y = [1, 2, 2, 3, 9, 4], [2, 1, 5, 5, 8, 4]
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in B.spearman(df, ["g"], "x", "y").collect()}
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert got["a"] == pytest.approx(want)
    assert got["b"] is None and got["c"] is None


def test_permutation_finds_a_planted_link(spark):
    df = spark.range(40).select(F.col("id").alias("u"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + F.col("id") % 3).alias("y"))
    got = B.spearman_permutation(df, [], "x", "y", "u", n_permutations=99).first()
    assert got.rho > 0.95 and got.p == pytest.approx(0.01)
    noise = df.withColumn("y", F.abs(F.hash("u")).cast("double"))
    assert B.spearman_permutation(noise, [], "x", "y", "u", n_permutations=99).first().p > 0.02


def test_degenerate_replicates_are_dropped(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 3.0)], "u int, x double, y double")
    got = B.spearman_interval(df, [], "x", "y", "u", n_resamples=200).first()
    assert 0 < got.n_resamples < 200


def test_window_membership(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([-6.0, -2.0, 0.0, 3.0, 5.0, 9.0])] + [("b", 0, -4.0), ("b", 1, 4.0)] + [("c", i, v) for i, v in enumerate([-9.0, 9.0, -8.0, 8.0])], "g string, u int, v double")
    got = {r.g: r for r in M.window_summary(df, ["g"], "v", "u", -4.0, 4.0, target=0.0, n_resamples=50).collect()}
    assert (got["a"].n_inside, got["a"].n) == (3, 6)
    assert (got["b"].n_inside, got["b"].n) == (2, 2)
    assert got["c"].mean_absolute_error == 8.5 and got["c"].mae_exceeds_window and got["c"].fraction_inside == 0


def test_membership_disagreement(spark):
    df = spark.createDataFrame([(1, 3.0, 5.0), (1, 5.0, 3.0), (1, 0.0, 0.0)], "g int, a double, b double")
    r = M.disagreement(df, ["g"], "a", "b", -4.0, 4.0).first()
    assert (r.n_disagree, r.n_only_a, r.n_only_b, r.offset_is_constant) == (2, 1, 1, False)


def test_unequal_sizes(spark):
    same = spark.createDataFrame([(g,) for g in "aabbcc"], "g string")
    other = spark.createDataFrame([(g,) for g in "aaabb"], "g string")
    assert M.unequal_sizes(same, "g").first().unequal is False
    assert tuple(M.unequal_sizes(other, "g").first()) == (True, "2,3")


def test_deltas_recover_the_planted_effect(grid):
    d = P.paired_deltas(grid, KEYS, ["ptm"])
    assert {round(r.delta_ptm, 9) for r in d.where("beta = 3").collect()} == {-0.3}


def test_missing_reference_stays_missing(grid):
    d = P.paired_deltas(grid.where("NOT (entry = 'complex1' AND beta = 0)"), KEYS, ["ptm"])
    rows = d.where("entry = 'complex1'").collect()
    assert len(rows) == 4 and all(r.delta_ptm is None and not r.has_reference for r in rows)


def test_duplicate_reference_is_refused(grid):
    twice = grid.unionByName(grid.where("entry = 'complex1' AND beta = 0"))
    assert P.duplicated_references(twice, KEYS, "beta").count() == 1
    with pytest.raises(Exception, match="more than one reference"):
        P.paired_deltas(twice, KEYS, ["ptm"]).collect()
    both = P.paired_deltas(twice.withColumn("second", F.col("ptm")), KEYS, ["ptm", "second"])
    for some in (["delta_second"], ["beta"]):
        with pytest.raises(Exception, match="more than one reference"):
            both.select(*some).collect()


def test_balanced_panel_and_report(grid):
    short = grid.where("NOT (entry IN ('complex3', 'complex4') AND abs(beta) = 3)")
    assert P.balanced_panel(short, KEYS).count() == 15
    rows = {r.beta: r for r in P.pairing_report(short, KEYS).collect()}
    assert (rows[None].n_lineages, rows[None].n_lineages_complete) == (5, 3)
    assert rows[0.0].n_rows == 5 and rows[3.0].n_rows == 3
    assert P.balanced_panel(grid, KEYS, wanted=[]).count() == 0


def test_completeness_is_strict_about_the_gap(grid):
    short = grid.where("NOT (entry = 'complex3' AND beta = 3)")
    got = {r.beta: r.depleted for r in P.completeness(short, 5).collect()}
    assert got[3.0] and not got[0.0]


def test_retained_keeps_rows_without_reference(spark):
    df = spark.createDataFrame([("a", 0.0, 85.0), ("a", 3.0, 75.0), ("a", 1.5, 74.9), ("b", 3.0, 20.0)], "k string, beta double, c double")
    got = {(r.k, r.beta) for r in P.retained(df, ["k"], "c", 10.0).collect()}
    assert got == {("a", 0.0), ("a", 3.0), ("b", 3.0)}


def test_partly_filled_control(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, c double")
    with pytest.raises(ValueError, match="have no c"):
        P.apply_control_policy(df, "c")
    assert P.apply_control_policy(df, "c", "drop").count() == 1
    assert P.apply_control_policy(df, "c", "no-control").count() == 2


def test_region_slopes_share_and_guards(spark):
    rows = []
    for c in range(3):
        for b in DOSES:
            shift = b if c < 2 else 0.0
            row = [c, b]
            for share in (0.5, 0.3, 0.2):
                row.append(shift * share)
            rows.append((*row, shift, 10, 30, 60, 100))
    names = [f"charge_shift_{r}_simple" for r in REGIONS] + ["charge_shift_total_simple"] + [f"n_residues_{r}" for r in REGIONS] + ["n_residues_total"]
    df = spark.createDataFrame(rows, ["complex", "beta", *names])
    got = S.region_slopes(df, ["complex"]).toPandas()
    assert set(got["complex"]) == {0, 1}  # no variation, no slope
    one = got[got["complex"] == 0].set_index("region")
    assert one.slope["interface"] == pytest.approx(0.5) and one.ratio["interface"] == pytest.approx(5.0)
    assert S.region_slopes(df.where("beta >= 1.5"), ["complex"]).count() == 0


def test_position_slopes_add_up(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-1, 2, (6, 10)).astype(float)
    x = q.sum(axis=1)
    rows = [(1, j, float(q[i, j]), float(x[i])) for i in range(6) for j in range(10)]
    got = S.position_slopes(spark.createDataFrame(rows, "k int, pos int, q double, x double"), ["k"], "q", "x").toPandas()
    assert got.slope.sum() == pytest.approx(1.0)


def test_matched_draws_take_each_position_once(spark):
    rows = [("c", p, "interface" if p % 4 == 0 else "surface", (p % 10) / 10 + 0.01, float(p)) for p in range(80)]
    df = spark.createDataFrame(rows, "k string, pos int, region string, area double, slope double")
    got = S.matched_draws(df, "k", "area", width=0.1, n_draws=5, seed=1).toPandas()
    assert not got.duplicated(["rep", "pos"]).any()
    need = df.where("region = 'interface'").toPandas().assign(s=lambda d: (d.area // 0.1)).groupby("s").size()
    have = got.groupby(["rep", "_stratum"]).size()
    pool = df.where("region = 'surface'").toPandas().assign(s=lambda d: (d.area // 0.1)).groupby("s").size()
    for (_, s), n in have.items():
        assert n == min(need[s], pool[s])


@pytest.mark.parametrize("overall,inner,text", [(True, True, "also among"), (True, False, "not among"), (False, True, "collider"), (False, False, "no measurable")])
def test_four_readings(spark, overall, inner, text):
    rows = [("all_returned", -1.0, overall), ("held_up", -1.0, inner)]
    df = spark.createDataFrame(rows, "subset string, estimate double, excludes_zero boolean")
    assert text in RD.quality_reading(df).first().reading
    assert "no quality control" in RD.quality_reading(df.where("subset = 'all_returned'")).first().reading


def test_pluggable_statistic(spark):
    df = spark.range(30).select(F.col("id").alias("u"), (F.col("id") * 1.0).alias("v"))
    assert B.bootstrap_interval(df, [], "v", "u", n_resamples=40, statistic="median").first().estimate == 14.5
    assert B.bootstrap_interval(df, [], "v", "u", n_resamples=40, statistic=F.max).first().estimate == 29.0


def test_ranges_do_not_change_a_median(spark, monkeypatch):
    df = spark.range(100).select(F.lit("g").alias("g"), F.sqrt("id").alias("v"))
    one = O.medians(df, ["g"], ["v"]).first().median
    monkeypatch.setattr(O, "SMALL", 0)
    assert O.medians(df, ["g"], ["v"]).first().median == one


def test_a_column_aggregate_gives_the_same_in_blocks_and_rows(spark, monkeypatch):
    """Its draws are made from arrays as well, and never joined by slot; packs and batches of any size agree."""
    df = spark.range(70).select((F.col("id") % 2).alias("g"), F.col("id").alias("u"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    run = lambda: B.bootstrap_interval(df, ["g"], "v", "u", n_resamples=40, statistic=F.stddev_pop)
    monkeypatch.setattr(B, "PACKED", 16)
    monkeypatch.setattr(B, "EMITTED", 10)
    monkeypatch.setattr(B, "draws", None)
    blocks = sorted(tuple(r) for r in run().collect())
    monkeypatch.undo()
    monkeypatch.setattr(B, "BROADCAST_UNITS", 0)
    assert [tuple(map(pytest.approx, r)) for r in sorted(tuple(r) for r in run().collect())] == blocks


def test_many_units_in_small_groups_are_drawn_in_blocks(spark, monkeypatch):
    """The largest group decides, not the units of all groups together."""
    df = spark.range(60).select((F.col("id") % 6).alias("g"), F.col("id").alias("u"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    want = sorted(tuple(r) for r in B.bootstrap_interval(df, ["g"], "v", "u", n_resamples=20).collect())
    monkeypatch.setattr(B, "BROADCAST_UNITS", 10)
    monkeypatch.setattr(B, "draws", None)
    assert sorted(tuple(r) for r in B.bootstrap_interval(df, ["g"], "v", "u", n_resamples=20).collect()) == want


def test_only_scored_documents_are_reduced_and_once(spark, tmp_path, monkeypatch):
    from titrant.plans import views as V
    from titrant.plans.inference_queries import merged

    texts = ["KKDE", "..1 2", "", None, "gaVl\n", "bjoux", "RRRW", "k"]
    docs = [(i, x, "en", "web", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(0, 1, 0), (1, 1, 0), (3, 0, 0), (4, 0, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (99, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id: r.seq for r in V.seqs(spark, str(tmp_path)).collect()} == {0: "KKDE", 4: "GAVL", 6: "RRRW", 7: "K"}
    plan = lambda: merged(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan().count("regexp_replace") == 1 and "LeftSemi" in plan()
    run = lambda: sorted((r.doc_id, r.folded, r.outside) for r in merged(spark, str(tmp_path)).collect())
    found = run()
    assert [x[:2] for x in found] == [(0, 1.0), (4, 0.0), (7, 0.0), (7, 1.0)]
    monkeypatch.setattr(V, "SCORED_IDS", 0)
    assert "LeftSemi" not in plan() and run() == found


def test_an_answer_is_drawn_only_as_far_as_it_takes(spark, monkeypatch):
    """Groups far from 0, at its edge and without variation: the same answers as all intervals give."""
    rng = np.random.default_rng(8)
    rows = []
    for kind, scores in {"far": (-6.0, -1.0, 3.0), "edge": (-1.7, -1.8, -1.9), "over": (-2.05, -0.2), "near": (-1.0, -0.3, 0.5), "up": (2.0, 8.0), "flat": (None, -0.5)}.items():
        for k, score in enumerate(scores):
            v = rng.normal(size=200)
            v = np.full(200, -1.0) if score is None else v - v.mean() + score * v.std() / np.sqrt(200)
            rows += [(kind, k, i, float(x)) for i, x in enumerate(v)]
    rows += [(None, 0, 1, -1.0), (None, 0, 2, None), ("none", 0, 1, None)]
    df = spark.createDataFrame(rows, "kind string, k int, unit int, v double")
    monkeypatch.setattr(B, "TRIED", 256)
    drawn = []
    blocks = B.in_blocks
    monkeypatch.setattr(B, "in_blocks", lambda slots, groups, columns, n, seed, sizes, kernel, **kw: drawn.append(sizes[0] * (n - kw.get("first", 0))) or blocks(slots, groups, columns, n, seed, sizes, kernel, **kw))
    every = B.bootstrap_interval(df, ["kind", "k"], "v", "unit", n_resamples=2000, seed=3)
    want = {}
    for r in every.collect():
        want[r.kind] = want.get(r.kind, False) or (r.excludes_zero and r.estimate < 0)
    all_of_them = drawn.pop()
    got = {r.kind: r.fell for r in B.fallen(df, ["kind", "k"], ["kind"], "v", "unit", n_resamples=2000, seed=3).collect()}
    assert got == want and {True, False} == set(want.values()) and 0 < sum(drawn) < all_of_them * 0.7
    monkeypatch.setattr(B, "BROADCAST_UNITS", 10)
    some = df.where("kind = 'far' AND k < 2")
    assert [tuple(r) for r in B.fallen(some, ["kind", "k"], ["kind"], "v", "unit", n_resamples=100).collect()] == [("far", True)]


def test_a_reading_leaves_out_draws_that_cannot_change_it(spark, monkeypatch):
    from titrant.operators import pairing as P
    from titrant.plans import inference_queries as Q, views as V

    rng = np.random.default_rng(2)
    rows = [(p, f, float(b), 10.0 - (b in (1, 4)) + (b == 2) + float(rng.normal()), float(20 - 6 * b * (p % 3 == 0))) for p in range(80) for f in "AN" for b in range(6) if (p + b) % 11 or not b]
    rows += [(900, "A", 1.0, 3.0, 4.0), (901, "A", 0.0, None, 4.0), (901, "A", 1.0, 5.0, None), (None, "A", 0.0, 1.0, 1.0), (None, "A", 1.0, 1.0, 1.0)]
    g = spark.createDataFrame(rows, "part int, flag string, beta double, score double, conf double")
    monkeypatch.setattr(V, "grid", lambda *_: g)
    monkeypatch.setattr(Q, "N", 1000)
    units, blocks = [], B.in_blocks
    monkeypatch.setattr(B, "in_blocks", lambda slots, groups, columns, n, seed, sizes, kernel, **kw: units.append(sizes[0] * (n - kw.get("first", 0))) or blocks(slots, groups, columns, n, seed, sizes, kernel, **kw))
    got = Q.p18(spark, None).collect()
    tagged = lambda df, name: P.paired_change(df, V.LINEAGE, "score").withColumn("subset", F.lit(name))
    both = tagged(g, "all_returned").unionByName(tagged(P.retained(g, V.LINEAGE, "conf", 10.0), "held_up"))
    per = both.groupBy("subset", "part", "beta").agg(F.avg("delta").alias("delta"))
    few = sum(units)
    want = RD.quality_reading(B.bootstrap_interval(per, ["subset", "beta"], "delta", "part", n_resamples=1000)).collect()
    assert got == want and want[0].overall and want[0].folded and few < 0.5 * (sum(units) - few)
