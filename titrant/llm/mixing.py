"""Mixing sources to target weights by fitting a word budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from titrant.llm.shared import WORD, row_id, written
from titrant.operators.ordering import ordered_index

#: Documents of one source and length are ranked in hash ranges of about this many rows.
RANGE_ROWS = 2_000
#: The exact fit covers a remaining budget of this many words, or a little more.
FIT_WORDS = 4_096


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds `target` to (s_key, source, source_size): shares of all words by weight, no more than
    `most` times a source's own words, the excess shared again by weight until none is above.

    Weights repeat in code point order of the sources, null last. The level per unit of weight only
    rises while sources reach their limit, so each round is one small aggregate.
    """
    ordered = ordered_index(
        sources, [F.col("source").isNull(), F.col("source"), F.col("s_key")], name="place"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    weighed = written(ordered.withColumn("weight", weight).drop("place"), "mix-sources")
    level, held = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("held"),
        ).first()
        if row["held"] == held or not row["total"] or not row["open"]:
            break
        held, level = row["held"], (row["total"] - row["capped"]) / row["open"]
    level = float(level or 0.0)
    return weighed.withColumn(
        "target", F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight"))
    )


def subset_fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to `budget`
    from below.

    Every length first gives its proportional part, rounded down. One more of the longest lengths
    follows while plenty remains, and a bounded-knapsack table fits what is left.
    """
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total == 0:
        return take
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    left = budget - int((take * lengths).sum())
    by_length = np.argsort(-lengths, kind="stable")
    for i in by_length:
        if take[i] < counts[i] and 0 < lengths[i] <= left - FIT_WORDS:
            take[i] += 1
            left -= int(lengths[i])
    reach, choice = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64)
    reach[0] = True
    for i in by_length:
        step, spare = int(lengths[i]), int(counts[i] - take[i])
        if not 0 < step <= left:
            continue
        fresh = reach.copy()
        for _ in range(min(spare, left // step)):
            moved = np.zeros(left + 1, bool)
            moved[step:] = fresh[:-step]
            fresh = moved & ~reach
            if not fresh.any():
                break
            choice[fresh] = i
            reach |= fresh
        if reach[left]:
            break
    place = int(np.flatnonzero(reach)[-1])
    while place:
        take[choice[place]] += 1
        place -= int(lengths[choice[place]])
    return take


def _quotas(group: pd.DataFrame) -> pd.DataFrame:
    source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    rounds = int(target // source_size) if source_size else 0
    group = group.sort_values("size")
    quota = subset_fit(group["size"].to_numpy(), group["n"].to_numpy(), int(round(target)) - rounds * source_size)
    return group.assign(rounds=rounds, quota=quota)[["s_key", "size", "n", "source_size", "target", "rounds", "quota"]]


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of `docs`.

    Documents are counted by exact length per source, so the group of one source holds a row per
    length and not per document. Whole rounds of a source are taken as often as its target allows;
    the rest of the budget is fitted by `subset_fit`, and documents of a length are chosen in order
    of a seeded hash of doc_id. Any number of documents of one length spreads over hash ranges.

    A null or blank text has size 0 and is never taken; null sources form one source; rows that
    repeat a doc_id count one by one; an empty table gives no rows; other columns are not read.
    """
    sized = written(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), row_id()).alias("draw"),
        ),
        "mix-sizes",
    )
    lengths = sized.groupBy("s_key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = lengths.groupBy("s_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources, weights, most).select("s_key", "source_size", "target")
    quotas = written(
        lengths.drop("source").join(aims, "s_key").groupBy("s_key").applyInPandas(
            _quotas,
            "s_key string, size bigint, n bigint, source_size bigint, target double, rounds bigint, quota bigint",
        ),
        "mix-quotas",
    )
    # The hash as a number from 0 to 1, cut into as many ranges as the length has thousands of rows.
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    part = F.least(F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * ranges), ranges - 1)
    placed = sized.join(quotas, ["s_key", "size"]).withColumn("part", part)
    parts = placed.groupBy("s_key", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    running = W.partitionBy("s_key", "size").orderBy("part")
    parts = parts.withColumn("earlier", F.sum("in_part").over(running) - F.col("in_part")).drop("in_part")
    inside = W.partitionBy("s_key", "size", "part").orderBy("draw", "doc_id")
    chosen = placed.withColumn("rank", F.row_number().over(inside)).join(parts, ["s_key", "size", "part"])
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("earlier") + F.col("rank") <= F.col("quota")).cast("bigint")).otherwise(0)
    return chosen.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
