"""Near-duplicate vectors by sorted passes over concatenated random hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from titrant.llm.components import components
from titrant.llm.shared import back_to_id, row_id, written
from titrant.operators.ordering import ordered_index

#: Neighbours compared on either side, rows of a block, and bits of a sort key.
NEIGHBOURS, BLOCK, BITS = 64, 1024, 63
#: Share of pairs at exactly the threshold that all passes together may miss, by their expected rate.
MISSED = 0.001


def leading_bits(rows: int) -> int:
    """Bits of a key that leave half a window of `rows` evenly spread vectors, or less."""
    return max(1, math.ceil(math.log2(max(2, rows) / NEIGHBOURS)) + 1)


def passes_for(rows: int, cosine: float) -> int:
    """How many orders are needed for a pair to agree in the leading bits of one: in each bit it
    does so with 1 - angle / pi, however the other vectors lie."""
    together = (1 - math.acos(cosine) / math.pi) ** leading_bits(rows)
    return max(4, math.ceil(math.log(MISSED) / math.log(1 - min(together, 0.99))))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(passes: int):
    """Adds a sort key per pass: the signs of BITS random projections, the first one leading."""

    def keys(vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), passes), np.int64)
        for d, part in vectors.groupby(vectors.map(len)):
            x = _unit(part)
            planes = np.random.default_rng(97 + int(d)).standard_normal((passes, d, BITS))
            powers = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            at = vectors.index.get_indexer(part.index)
            for k in range(passes):
                out[at, k] = ((x @ planes[k]) > 0) @ powers
        return pd.Series(list(out))

    keys.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(keys, T.ArrayType(T.LongType()))


def _neighbours(cosine: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links between a row of this block and one of the NEIGHBOURS rows before it."""
        group = group.sort_values("place")
        found = []
        for _, part in group.groupby(["pass", "label", "d"]):
            x, place, own, node = _unit(part["v"]), part["place"].to_numpy(), part["own"].to_numpy(), part["node"].to_numpy()
            near = (x @ x.T >= cosine) & (place[:, None] - place[None] <= NEIGHBOURS) & (place[:, None] > place[None]) & own[:, None]
            j, i = np.nonzero(near)
            found.append(pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}))
        return pd.concat(found).drop_duplicates()

    return compare


def _crossing(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between different components in one pair of chunks, no more than join them."""
        links = []
        for _, part in rows.groupby(["pass", "label", "d", "prefix"]):
            left, right = part[~part["right"]], part[part["right"]]
            if not len(left) or not len(right):
                continue
            own, other = left["component"].to_numpy(), right["component"].to_numpy()
            i, j = np.nonzero((_unit(left["v"]) @ _unit(right["v"]).T >= cosine) & (own[:, None] != other[None]))
            # One link for two components is enough.
            _, some = np.unique(np.stack((own[i], other[j])), axis=1, return_index=True)
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for k in some:
                p, q = top(own[i[k]]), top(other[j[k]])
                if p != q:
                    up[p] = q
                    links.append((left["node"].iloc[i[k]], right["node"].iloc[j[k]]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _links_of_runs(keyed: DataFrame, found: DataFrame, bits: int, cosine: float) -> DataFrame:
    """(a, b) that join components within runs of one prefix that are longer than the window.

    Members outside a run's largest component are compared with all its members, in chunks: of m
    members with k outside, k * m comparisons inside tasks, which return joining links only.
    """
    run = ["pass", "label", "d", "prefix"]
    placed = (
        keyed.withColumn("prefix", F.shiftright("key", BITS - bits)).drop("key")
        .join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    open_runs = written(
        placed.groupBy(*run, "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*run).agg(F.sum("n").alias("m"), F.max(F.struct("n", "component")).alias("most"))
        .where((F.col("m") > NEIGHBOURS + 1) & (F.col("m") > F.col("most.n")))
        .select(*run, "m", (F.col("m") - F.col("most.n")).alias("k"), F.col("most.component").alias("main")),
        "vector-runs",
    )
    half = BLOCK // 2
    bundles = max(1, (open_runs.agg(F.sum(F.when(F.col("m") <= half, F.col("m")))).first()[0] or 0) // half)
    small = F.col("m") <= half
    member = placed.join(open_runs, run).withColumn("g", F.when(small, F.pmod(F.xxhash64(*run), F.lit(bundles))).otherwise(F.xxhash64(*run)))
    wide = F.ceil(F.col("m") / half), F.ceil(F.col("k") / half)
    sides = [
        part.withColumn(own, F.pmod(F.xxhash64("node", "v"), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
        .select(small.alias("small"), "g", "i", "j", F.lit(right).alias("right"), *run, "node", "component", "v")
        for part, own, n, other, others, right in (
            (member.where("component <> main"), "i", wide[1], "j", wide[0], False), (member, "j", wide[0], "i", wide[1], True),
        )
    ]
    return written(
        sides[0].unionByName(sides[1]).groupBy("small", "g", "i", "j").applyInPandas(_crossing(cosine), "a bigint, b bigint"), "vector-pairs"
    )


def _counted(cosine: float):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the rows on the left side of one pair of chunks to those on the right side."""
        out = []
        for _, part in group.groupby(["component", "d", "label"]):
            left, right = part[part["side"] == 0], part[part["side"] == 1]
            if len(left) and len(right):
                near = (_unit(left["v"]) @ _unit(right["v"]).T >= cosine) & (left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None])
                out.append(pd.DataFrame({"node": left["node"].to_numpy(), "links": near @ right["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64")})

    return count


def linked_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Equal vectors of one label are one class with a count. Classes are ordered by (label, key) in
    several passes, each with keys of its own; every class is compared with the 64 before it, blocks
    overlapping by as many, so that no block border hides a neighbour. Where more classes than that
    share the leading bits of a key and verified pairs leave several components among them, they are
    compared whole. So a pair is missed only if its leading bits differ in every pass, which the
    number of passes keeps to MISSED at the threshold, however dense a label is. Verified pairs
    of all passes join components, and inside each component every pair is compared once more in
    chunks that only count, so that links are whole however many neighbours a vector has.

    A row links with nothing if its label is null or its vector null, empty, zero, or not finite
    throughout; vectors of different lengths never link. A missing vec_id sorts last, repeated ones
    act as one node, an empty table gives no rows, other columns are not read.
    """
    v = F.col("v")
    rows = vectors.select(row_id("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & F.col("label").isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = written(
        rows.where("good").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("v")),
        "vector-classes",
    )
    largest = classes.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 0
    passes, bits = passes_for(largest, cosine), leading_bits(largest)
    keyed = classes.select("node", "label", "d", "v", F.posexplode(_keyed(passes)("v")).alias("pass", "key"))
    placed = ordered_index(keyed, [F.col(c) for c in ("pass", "label", "d", "key", "node")], name="place")
    block = F.floor(F.col("place") / BLOCK)
    spread = placed.withColumn("block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("place") + NEIGHBOURS) / BLOCK)))))
    spread = spread.withColumn("own", F.col("block") == block)
    pairs = written(
        spread.select("block", "own", "place", "pass", "label", "d", "node", "v")
        .groupBy("block").applyInPandas(_neighbours(cosine), "a bigint, b bigint").where("a <> b").distinct(),
        "vector-pairs",
    )
    found = components(pairs.unionByName(_links_of_runs(keyed, components(pairs), bits, cosine)))
    members = written(found.join(classes, "node"), "vector-members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum(F.when(F.col("size") <= BLOCK, F.col("size")))).first()[0] or 0
    bundle = F.pmod(F.xxhash64("component"), F.lit(max(1, total // 256)))
    sized = members.join(sizes, "component").withColumn("chunks", F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(F.col("size") / (BLOCK // 2))))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    sized = sized.withColumn("chunk", chunk).withColumn("group", F.when(F.col("chunks") == 1, bundle).otherwise(F.col("component")))
    # Each class stands once on the left of every chunk of its component, and once on the right.
    other = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    left = other.select("group", "chunks", F.col("chunk").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "component", "label", "d", "node", "v", "copies")
    right = other.select("group", "chunks", F.col("other").alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"), "component", "label", "d", "node", "v", "copies")
    counts = (
        left.unionByName(right).withColumn("bundled", F.col("chunks") == 1)
        .groupBy("bundled", "group", "i", "j").applyInPandas(_counted(cosine), "node bigint, links bigint")
        .groupBy("node").agg(F.sum("links").alias("links"))
    )
    of_class = classes.join(counts, "node", "left").join(found, "node", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"),
    )
    return _attached(rows, of_class)


def _attached(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    found = rows.join(of_class.withColumn("good", F.lit(True)), ["label", "v", "good"], "left").withColumn("cid", F.coalesce("component", "id"))
    return found.select(
        back_to_id("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        back_to_id("cid").alias("component_id"), (F.col("id") == F.col("cid")).alias("kept"),
    )
