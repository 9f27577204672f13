"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from titrant.llm import kernels
from titrant.llm.components import components
from titrant.llm.shared import NO_ID, back_to_id, by_batch, keyed_texts, removed, written

#: Retained values per document, and the least estimated similarity that is verified. At a true
#: similarity of 0.75 the estimate has a standard deviation of 0.044, so one pair in 15,000 falls
#: below; a lower estimate or a wider sketch moves that as far as wanted.
SKETCH = 96
ESTIMATE = 0.58
SHINGLE = 5
#: Representatives of one side of a comparison inside one task.
CHUNK = 512


def _shingles(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text, as numbers from 0 to 2**63."""
    data, offsets = kernels.text_bytes(texts)
    for low, high in kernels.slabs(offsets):
        cut = offsets[low : high + 1]
        part, cut = data[cut[0] : cut[-1]], cut - cut[0]
        starts, ends, first = kernels.word_spans(part, cut)
        words = kernels.span_hashes(part, starts, ends, lower=True)
        runs = kernels.run_hashes(words, size) >> np.uint64(1)
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                # Fewer words than a shingle has: the whole sequence, told apart by its length.
                yield kernels.run_hashes(words[a:b] + np.uint64(b - a), int(b - a)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def _sketches(batch: pa.RecordBatch):
    """One row per text: the size of its set, two sums that name the set, and its least values."""
    counts, one, two, kept = [], [], [], []
    for values in _shingles(batch["text"], SHINGLE):
        counts.append(len(values))
        one.append(kernels.mix(values).sum(dtype=np.uint64))
        two.append(kernels.mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
        kept.append(values[:SKETCH])
    places = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
    flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            batch["id"], batch["th"], pa.array(counts, pa.int64()),
            pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
            pa.ListArray.from_arrays(pa.array(places), pa.array(flat)),
        ],
        ["id", "th", "n", "d1", "d2", "sketch"],
    )


def _sets(batch: pa.RecordBatch):
    sets = list(_shingles(batch["text"], SHINGLE))
    places = np.concatenate(([0], np.cumsum([len(k) for k in sets]))).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(places), pa.array(flat))], ["id", "shingles"])


def estimated(a: Column, b: Column) -> Column:
    """Similarity from two sketches: the share of the union's least values that both hold."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.size(least)


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have den * intersection >= num * union."""
    side = lambda t, c, x: t.select(F.col("id").alias(x), F.col(c).alias(f"s{x}"))
    likely = (
        pairs.join(side(sketches, "sketch", "a"), "a").join(side(sketches, "sketch", "b"), "b")
        .where(estimated(F.col("sa"), F.col("sb")) >= ESTIMATE)
        .select("a", "b")
    )
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        likely.join(side(sets, "shingles", "a"), "a").join(side(sets, "shingles", "b"), "b")
        .where(F.lit(den) * both >= F.lit(num) * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def _crossing(num: int, den: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Verified links between different components in one pair of chunks, no more than join them."""
        links = []
        for _, group in rows.groupby("a"):
            left, right = group[~group["right"]].reset_index(), group[group["right"]].reset_index()
            if not len(left) or not len(right):
                continue
            sketches, n = [*left["sketch"], *right["sketch"]], len(left)
            owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
            sizes, overlap = kernels.overlaps(np.concatenate(sketches), owner, n, len(right))
            least = np.ceil(ESTIMATE * np.maximum(sizes[:n, None], sizes[None, n:]) - 1e-9)
            a, b = np.nonzero((overlap >= least) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None]))
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for i, j in zip(a, b, strict=True):
                p, q = top(left["component"][i]), top(right["component"][j])
                x, y = left["shingles"][i], right["shingles"][j]
                if p == q or den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    up[p] = q
                    links.append((left["id"][i], right["id"][j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """(id, th, n_shingles, component, first) for every row: who is linked, directly or through others.

    1. One scan gives each text its number of distinct 5-word shingles and its 96 least hashes.
       Texts with one and the same set become one numbered representative, a node of the graph,
       so copies are never paired, and neither repeated nor missing ids join unlike texts.
    2. Inverted lists: a value held by one representative alone leads nowhere. A pair estimated at
       0.58 or more shares at least that part of either sketch, so of each sketch only the rarest
       values are listed, as many as such a pair cannot all miss; a representative with fewer
       shared values than the others has no partner. Phrases that very many texts share are thereby
       never listed for ordinary texts.
    3. Every member of a list is compared with the list's first and last member and with one named
       by a hash: sketches estimate, full sets verify, components join. Members of all lists with one
       first member are a group, and a group within one component is settled.
    4. In the other groups, the members outside the largest component are compared with members
       of other components, in chunks that hold the sets themselves and return no more links than
       join components, so no link between components is lost and no pairs are moved. A group of
       m members with k outside takes k * m comparisons of sketches.

    A component is named by its smallest doc_id; `first` marks rows of the representative that holds
    it, one without an id only where the component has no other. Rows without words have size 0, no
    links, and themselves as component. Rows that repeat a doc_id with other texts are linked one by
    one. Texts of any length are read whole; other columns are not read.
    """
    texts = keyed_texts(docs)
    rows = written(
        by_batch(texts, _sketches, "id bigint, th bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>"), "near-sketches"
    )
    # Numbers are given once, as the table is written, and read from then on.
    named = written(
        rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "th")).alias("lead"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "near-reps",
    )
    reps = named.select(F.col("node").alias("id"), "n", "sketch")
    held = reps.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = (
        held.join(shared, "value")
        .groupBy("id", "n", "k")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
        .withColumn("listed", F.size("found") - F.ceil(F.col("k") * ESTIMATE).cast("int") + 1)
        .where("listed > 0")
        .select("id", "n", F.explode(F.slice("found", F.lit(1), F.col("listed"))).alias("f"))
        .select("id", "n", "f.value")
    )
    listed = written(rare, "near-lists")
    nodes = listed.select("id").distinct()
    leads = named.join(nodes.withColumnRenamed("id", "node"), "node", "left_semi").select("lead.id", "lead.th", "node")
    sets = written(
        by_batch(texts.join(leads, ["id", "th"]).select(F.col("node").alias("id"), "text"), _sets, "id bigint, shingles array<bigint>").dropDuplicates(["id"]),
        "near-sets",
    )
    sketches = reps.join(nodes, "id", "left_semi").select("id", "sketch")

    # A third member by a hash that differs from list to list, so the members of a family of near
    # copies, which share many lists, are compared with many of them.
    ends = (
        listed.groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min_by("id", F.xxhash64("id", "value")).alias("y"))
        .where("a < z")
    )
    led = listed.join(ends, "value")
    stars = (
        led.where("id > a").select("a", F.col("id").alias("b"))
        .unionByName(led.where("id < z").select(F.col("id").alias("a"), F.col("z").alias("b")))
        .unionByName(led.where("id <> y").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")))
        .distinct()
    )
    first = written(_verified(stars, sketches, sets, num, den), "near-links")
    found = components(first)
    groups = led.select("a", "id").distinct()
    groups = groups.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = (
        groups.groupBy("a", "component").agg(F.count(F.lit(1)).alias("held"))
        .groupBy("a").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("m"))
        .select("a", F.col("most.component").alias("main"), "m", (F.col("m") - F.col("most.held")).alias("k"))
        .where("m > 2 and k > 0")
    )
    placed = written(groups.join(sizes, "a"), "near-open")
    wide = F.ceil(F.col("m") / CHUNK), F.ceil(F.col("k") / CHUNK)
    bundles = max(1, placed.count() // CHUNK)
    small = F.col("m") <= CHUNK
    placed = placed.withColumn("g", F.when(small, F.pmod(F.xxhash64("a"), F.lit(bundles))).otherwise(F.col("a"))).withColumn("one", small)
    # Left chunks hold members outside the main component, right chunks all; each pair of chunks
    # meets once.
    both = [
        part.withColumn(own, F.pmod(F.xxhash64("id"), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
        .select("one", "g", "i", "j", F.lit(right).alias("right"), "a", "id", "component")
        for part, own, n, other, others, right in (
            (placed.where("component <> main"), "i", wide[1], "j", wide[0], False), (placed, "j", wide[0], "i", wide[1], True),
        )
    ]
    both = both[0].unionByName(both[1])
    second = written(
        both.join(sketches, "id").join(sets, "id").groupBy("one", "g", "i", "j").applyInPandas(_crossing(num, den), "a bigint, b bigint"),
        "near-links",
    )
    joined = components(first.unionByName(second))
    removed(listed, sets)
    group = named.select("d1", "d2", "n", "node", "lead").join(joined, "node", "left").withColumn("group", F.coalesce("component", "node"))
    names = group.groupBy("group").agg(F.min(F.struct(F.col("lead.id").alias("id"), F.col("node").alias("node"))).alias("name"))
    of_rep = group.join(names, "group").select(
        "d1", "d2", "n", F.col("name.id").alias("component"), (F.col("node") == F.col("name.node")).alias("first")
    )
    return (
        rows.select("id", "th", "n", "d1", "d2")
        .join(of_rep, ["d1", "d2", "n"], "left")
        .select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), F.coalesce("first", F.lit(True)).alias("first"))
    )


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(
        back_to_id("id").alias("doc_id"), "n_shingles", back_to_id("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, less those whose component holds a smaller doc_id. Of exact repeats of a
    row one stays; rows without words all stay, but for such repeats. A component in which no row has
    an id keeps one of its texts."""
    kept = near_duplicates(docs).where("first and id = component").select("id", "th").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(kept, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("row.*")
