import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from titrant.operators import ordering as O


@pytest.fixture(params=["one window", "many ranges"])
def split(request, monkeypatch):
    """Run every case both ways: as a small table, and cut into ranges as a large one would be."""
    if request.param == "many ranges":
        monkeypatch.setattr(O, "SMALL", 0)
        monkeypatch.setattr(O, "LARGEST", 20)


@pytest.fixture(scope="module")
def skewed():
    """One group holds most rows and one value a third of them."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        g = "hot" if i % 10 else f"g{i % 7}"
        rows.append((i, g, 5.0 if i % 3 == 0 else round(rng.uniform(-50, 50), 1)))
    return pd.DataFrame(rows, columns=["id", "g", "v"])


def test_quantiles_match_numpy(spark, skewed, split):
    got = O.quantiles(spark.createDataFrame(skewed), ["g"], "v", {"low": 0.025, "mid": 0.5, "high": 0.9}).toPandas().set_index("g")
    for g, block in skewed.groupby("g"):
        want = np.quantile(block.v, [0.025, 0.5, 0.9])
        assert got.loc[g, ["low", "mid", "high"]].to_numpy(float) == pytest.approx(want)


def test_selection_narrows_to_the_wanted_places(spark, monkeypatch):
    """One large group beside a null one: a few rows are left to the window, and the answer is exact."""
    rng = np.random.default_rng(2)
    large, small = rng.normal(size=5000).round(3), rng.normal(size=7).round(3)
    df = spark.createDataFrame([("big", float(v)) for v in large] + [(None, float(v)) for v in small] + [("none", None)], "g string, v double").repartition(3)
    monkeypatch.setattr(O, "LARGEST", 300)
    left = O.selected(df, ["g"], "v", lambda total: [F.floor(total / 2), F.floor(total / 10)])
    assert left.where("g = 'big'").count() < 600
    got = {r.g: (r.a, r.b) for r in O.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.901}).collect()}
    for g, block in (("big", large), (None, small)):
        assert got[g] == pytest.approx(np.quantile(block, [0.5, 0.901]))
    assert set(got) == {"big", None}
    both = O.quantiles(df, [], "v", {"m": 0.5}).first().m
    assert both == pytest.approx(np.median(np.concatenate([large, small])))


def test_average_ranks_match_pandas(spark, skewed, split):
    got = {(r.g, r.value): r["rank"] for r in O.average_ranks(spark.createDataFrame(skewed), ["g"], "v").collect()}
    want = skewed.assign(rank=skewed.groupby("g").v.rank())
    for r in want.itertuples():
        assert got[(r.g, r.v)] == r.rank


def test_upper_median_is_an_element(spark, skewed, split):
    got = {r.g: r.upper_median for r in O.upper_median(spark.createDataFrame(skewed), ["g"], "v").collect()}
    for g, block in skewed.groupby("g"):
        assert got[g] == sorted(block.v)[len(block) // 2]


def test_range_of_counts_cuts_below(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 2.0, 9.0)], "v double")
    got = [r[0] for r in df.select(O.range_of(F.col("v"), [0.0, 1.0, 2.0])).collect()]
    assert got == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("width,small", [(1, False), (3, False), (1, True)])
def test_hash_index_does_not_depend_on_the_split(spark, skewed, width, small):
    df = spark.createDataFrame(skewed)
    got = O.hash_index(df, ["g"], O.hash_order(F.lit("s"), F.col("g"), F.col("id")), width=width, small=small).toPandas()
    import hashlib

    got["key"] = [hashlib.md5(f"s|{r.g}|{r.id}".encode()).hexdigest() for r in got.itertuples()]
    for _, block in got.groupby("g"):
        assert block.sort_values("key").slot.tolist() == list(range(len(block)))
        assert set(block.n) == {len(block)}


def test_ordered_index_over_the_whole_table(spark, skewed):
    got = O.ordered_index(spark.createDataFrame(skewed).repartition(4), [F.col("v"), F.col("id")]).toPandas()
    want = skewed.sort_values(["v", "id"]).id.tolist()
    assert got.sort_values("position").id.tolist() == want
