"""Nearest-value matching against a plain loop, and designs threaded on backbones of fixed length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrant.operators import matching_null as MN, resample as B, threading as TH


def plain_matches(pool, targets, priority):
    """Target by target: the nearest place still free, by priority among equally near ones."""
    free, out = sorted(range(len(pool)), key=lambda i: (priority[i], i)), []
    for wanted in targets:
        if not free:
            break
        off = [abs(pool[i] - wanted) for i in free]
        out.append((free.pop(int(np.argmin(off))), min(off)))
    return out


@pytest.mark.parametrize("step", [0.25, 0.0625])
def test_nearest_matches_are_those_of_a_plain_loop(step):
    """Values are binary fractions, so equal distances are equal; priorities tie in some cases."""
    r = np.random.default_rng(7)
    for case in range(150):
        n = int(r.integers(1, 25))
        pool, targets = r.integers(0, 1 / step, n) * step, r.integers(0, 1 / step, int(r.integers(1, n + 4))) * step
        priority = r.integers(0, 4 if case % 3 == 0 else 10**6, (5, n))
        got = list(MN.nearest_matches(pool, targets, priority))
        for d in range(5):
            assert [(int(c[d]), e[d]) for c, e in got] == plain_matches(pool, targets, priority[d])


def positions(spark):
    r = np.random.default_rng(1)
    rows = []
    for k, (inside, outside) in {"a": (6, 20), "short": (5, 4), "none": (0, 7), "even": (3, 3)}.items():
        for p in range(inside + outside):
            rows.append((k, p, "interface" if p < inside else "surface", float(r.integers(0, 16)) / 16, float(r.normal())))
        rows.append((k, inside + outside, "core", 0.5, 1.0))
    return rows, spark.createDataFrame(rows, "k string, pos int, region string, area double, slope double")


@pytest.mark.parametrize("cells", [1_000_000, 30])
def test_nearest_null_keeps_every_complex(spark, monkeypatch, cells):
    monkeypatch.setattr(MN, "CELLS", cells)
    rows, df = positions(spark)
    got = {r.k: r for r in MN.nearest_null(df.repartition(3), "k", "area", n_draws=40, seed=3).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "matched", "even": "matched", "none": "skipped: no interface", "short": "skipped: surface pool smaller than interface"}
    pairs = MN.matched_pairs(df, "k", "area", n_draws=40, seed=3).toPandas()
    for k in ("a", "even"):
        own = [x for x in rows if x[0] == k]
        inside, outside = [x for x in own if x[2] == "interface"], [x for x in own if x[2] == "surface"]
        slope, ratios = {x[1]: x[4] for x in own}, []
        for _, draw in pairs[pairs.k == k].groupby("rep"):
            assert sorted(draw.target) == [x[1] for x in inside] and draw.pos.is_unique and set(draw.pos) <= {x[1] for x in outside}
            ratios.append(sum(slope[p] for p in draw.pos) / (len(inside) / len(own)))
        seen = sum(slope[x[1]] for x in inside) / (len(inside) / len(own))
        assert (got[k].n_sampled, got[k].n_draws) == (len(inside), 40)
        assert got[k].mean_match_error == pytest.approx(pairs[pairs.k == k].error.mean())
        assert (got[k].observed_ratio, got[k].null_mean_ratio) == (pytest.approx(seen), pytest.approx(np.mean(ratios)))
        assert got[k].null_sd_ratio == pytest.approx(np.std(ratios, ddof=1), abs=1e-9)
        far = np.abs(np.array(ratios) - np.mean(ratios)) >= abs(seen - np.mean(ratios)) - 1e-12
        assert got[k].p_permutation == pytest.approx((far.sum() + 1) / 41) or k == "even"
    assert got["none"].observed_ratio is None and got["short"].n_sampled == 0


def test_draws_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Arrays per block and rows joined by slot give the same intervals, permutations included."""
    r = np.random.default_rng(5)
    rows = [(f"g{i % 3}", i, float(round(r.normal(), 1)), float(round(r.normal(), 1))) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, u int, x double, y double")
    run = lambda: [
        sorted(tuple(r) for r in t.collect()) for t in (
            B.bootstrap_interval(df, ["g"], "x", "u", n_resamples=60), B.bootstrap_interval(df, ["g"], "x", "u", n_resamples=60, statistic="median"),
            B.spearman_interval(df, ["g"], "x", "y", "u", n_resamples=60), B.spearman_permutation(df, ["g"], "x", "y", "u", n_permutations=60))]
    blocks = run()
    monkeypatch.setattr(B, "BROADCAST_UNITS", 0)
    for one, two in zip(blocks, run(), strict=True):
        for a, b in zip(one, two, strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_draw_hash_is_the_same_in_columns_and_arrays(spark):
    x = np.arange(0, 2**32, 2**25 + 12345)
    got = [r.h for r in spark.createDataFrame([(int(v),) for v in x], "v bigint").select(B.mixed(F.col("v")).alias("h"), "v").orderBy("v").collect()]
    assert got == B.mixed(x).tolist() and min(got) >= 0 and max(got) < 2**31
    # Even enough to draw with: each tenth of the units gets about a tenth of the picks.
    picks = B.mixed(B.mixed(np.arange(1000) + 77)[None] + B.mixed(np.arange(200) + B.REPLICATE)[:, None]) % 1000
    assert np.all(np.abs(np.histogram(picks, 10, (0, 1000))[0] / picks.size - 0.1) < 0.005)
    assert len(np.unique(picks[0])) < 700 < 1.3 * len(np.unique(picks[0]))


def test_every_design_has_an_account(spark):
    designs = spark.createDataFrame([(1, "ACD"), (2, "ACDE"), (3, "AC"), (5, "A"), (6, None), (7, "AC"), (7, "AD"), (8, "ACD")], "d int, seq string")
    places = {1: [0, 1, 2], 2: [0, 1, 2], 3: [0, 1, 2], 4: [0], 6: [0], 7: [0, 1], 8: [0, 1, 1]}
    backbones = spark.createDataFrame([(d, p) for d, ps in places.items() for p in ps], "d int, pos bigint")
    accounts = TH.account(designs, backbones, "d")
    assert {r.d: r.status for r in accounts.collect()} == {
        1: "threaded", 2: "refused: length differs", 3: "refused: length differs", 4: "no design", 5: "refused: no backbone",
        6: "refused: length differs", 7: "refused: repeated design", 8: "refused: positions are not 0 to n - 1"}
    letters = TH.threaded_letters(designs, accounts, "d").orderBy("pos").collect()
    assert [tuple(r) for r in letters] == [(1, 0, "A"), (1, 1, "C"), (1, 2, "D")]
