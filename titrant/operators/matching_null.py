"""Nearest-value matching without replacement, and the null of a ratio that is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from titrant.operators.ordering import hash_order
from titrant.operators.resample import PRIME, REPLICATE, mixed

# Places of the pool times draws that one task orders at once.
CELLS = 1_000_000


def _next_free(links: np.ndarray, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The end of the chain of links that starts at x, per row; every x then points there itself."""
    end = links[rows, x]
    while True:
        further = links[rows, end]
        if np.array_equal(further, end):
            break
        end = further
    links[rows, x] = end
    return end


def nearest_matches(pool: np.ndarray, targets: np.ndarray, priority: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chosen, error) for each target in turn, over all draws: the place in `pool` of the nearest
    value that the draw has not taken yet, and how far off it is.

    Each row of `priority` is a draw; among equally near places the one of least priority is taken.
    Equal values of the pool are one group, ordered by priority; an empty group links to its
    neighbours, so the next free value on either side is found along links that shorten as they are
    used, like the sets of a union-find. Ends when the pool is empty.
    """
    n_draws, n = priority.shape
    values, group = np.unique(pool, return_inverse=True)
    size = np.bincount(group, minlength=len(values))
    # Places by group, then by priority, then by place.
    by_place = np.argsort(group, kind="stable")
    within = np.argsort(priority[:, by_place], axis=1, kind="stable")
    order = np.take_along_axis(
        np.broadcast_to(by_place, priority.shape), np.take_along_axis(within, np.argsort(group[by_place][within], axis=1, kind="stable"), axis=1), axis=1
    )
    ends = np.cumsum(size)
    head = np.broadcast_to(ends - size, (n_draws, len(values))).copy()
    # One more place on each side stands for none; group g is place g + 1.
    left = np.broadcast_to(np.arange(len(values) + 2), (n_draws, len(values) + 2)).copy()
    right = left.copy()
    rows = np.arange(n_draws)
    far = np.concatenate(([-np.inf], values, [np.inf]))
    for wanted in targets[:n]:
        at = int(np.searchsorted(values, wanted, side="right"))
        low = _next_free(left, rows, np.full(n_draws, at))
        high = _next_free(right, rows, np.full(n_draws, at + 1))
        below, above = wanted - far[low], far[high] - wanted
        tied = np.flatnonzero(below == above)
        take = np.where(below <= above, low, high)
        if len(tied):
            mine = [order[tied, np.minimum(head[tied, side[tied] - 1], n - 1)] for side in (low, high)]
            p = [priority[tied, m] for m in mine]
            take[tied] = np.where((p[0] < p[1]) | ((p[0] == p[1]) & (mine[0] < mine[1])), low[tied], high[tied])
        g = take - 1
        chosen = order[rows, head[rows, g]]
        head[rows, g] += 1
        empty = np.flatnonzero(head[rows, g] == ends[g])
        left[empty, take[empty]] = take[empty] - 1
        right[empty, take[empty]] = take[empty] + 1
        yield chosen, np.abs(pool[chosen] - wanted)


def _sides(rows: pd.DataFrame, area: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows = rows.sort_values("pos")
    return rows[rows["region"] == "surface"], rows[(rows["region"] == "interface") & rows[area].notna()]


def _priorities(rows: pd.DataFrame, pool: pd.DataFrame, reps: np.ndarray) -> np.ndarray:
    base = mixed((pool["pos"].to_numpy(np.int64) + int(rows["_key"].iloc[0])) % PRIME)
    return mixed(base[None] + mixed(reps + REPLICATE)[:, None])


def _blocks(positions: DataFrame, key: str, area: str, n_draws: int, seed: int) -> tuple[DataFrame, int]:
    """Positions with a hash of their complex, once per block of draws. Few complexes take more
    blocks, so that all tasks have work; draws do not depend on it."""
    n_keys = positions.select(key).distinct().count()
    n_blocks = min(n_draws, max(1, -(-64 // max(n_keys, 1))))
    hashed = F.conv(F.substring(hash_order(F.lit(str(seed)), F.col(key)), 1, 7), 16, 10).cast("bigint").alias("_key")
    block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block")
    return positions.select(key, "pos", "region", "slope", F.col(area).cast("double").alias(area), hashed, block), n_blocks


def _drawn(rows: pd.DataFrame, area: str, n_draws: int, n_blocks: int):
    """(reps, pool, targets, matches) for parts of the draws of one block."""
    pool, targets = _sides(rows, area)
    pool = pool[pool[area].notna()]
    if not len(pool) or not len(targets):
        return
    reps = np.arange(int(rows["_block"].iloc[0]), n_draws, n_blocks)
    step = max(1, CELLS // len(pool))
    for low in range(0, len(reps), step):
        part = reps[low : low + step]
        yield part, pool, targets, nearest_matches(pool[area].to_numpy(), targets[area].to_numpy(), _priorities(rows, pool, part))


def matched_pairs(positions: DataFrame, key: str, area: str, *, n_draws: int, seed: int = 0) -> DataFrame:
    """(key, rep, target, pos, wanted, area, error): which surface position each interface position
    is matched with in each draw. One row per pair, so for inspection of a few draws."""
    each, n_blocks = _blocks(positions, key, area, n_draws, seed)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: np.zeros(0) for c in ("rep", "target", "pos", "wanted", area, "error")})]
        for reps, pool, targets, matches in _drawn(rows, area, n_draws, n_blocks):
            for (target, wanted), (chosen, error) in zip(zip(targets["pos"], targets[area]), matches):
                found.append(pd.DataFrame({
                    "rep": reps, "target": target, "pos": pool["pos"].to_numpy()[chosen],
                    "wanted": wanted, area: pool[area].to_numpy()[chosen], "error": error}))
        pairs = pd.concat(found[1:] or found, ignore_index=True)
        pairs.insert(0, key, np.full(len(pairs), rows[key].iloc[0], object))
        return pairs

    kind = positions.schema[key].dataType.simpleString()
    return each.groupBy(key, "_block").applyInPandas(run, f"`{key}` {kind}, rep int, target bigint, pos bigint, wanted double, `{area}` double, error double")


def nearest_null(positions: DataFrame, key: str, area: str, *, n_draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row per complex: the observed interface ratio against `n_draws` samples of its surface,
    each target matched with the nearest free value of `area`, and an add-one p-value.

    `mean_match_error` is the mean over targets and draws of |chosen - wanted|. `n_sampled` is the
    number of targets matched in every draw. A complex that cannot be matched keeps its row with the
    reason in `status` and nulls for the rest. Null areas are neither targets nor in the pool.
    """
    each, n_blocks = _blocks(positions, key, area, n_draws, seed)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pool, targets = _sides(rows, area)
        n = len(rows)
        ratios, errors, sampled = [], [], 0
        if 0 < len(targets) <= pool[area].notna().sum():
            for reps, usable, targets_, matches in _drawn(rows, area, n_draws, n_blocks):
                slopes, total, off, sampled = usable["slope"].to_numpy(), np.zeros(len(reps)), np.zeros(len(reps)), 0
                for chosen, error in matches:
                    total += slopes[chosen]
                    off += error
                    sampled += 1
                ratios.append(total / (sampled / n))
                errors.append(off / sampled)
        return pd.DataFrame({
            key: [rows[key].iloc[0]], "n_sampled": [sampled], "ratios": [np.concatenate(ratios) if ratios else np.zeros(0)],
            "errors": [np.concatenate(errors) if errors else np.zeros(0)]})

    kind = positions.schema[key].dataType.simpleString()
    blocks = each.groupBy(key, "_block").applyInPandas(run, f"`{key}` {kind}, n_sampled bigint, ratios array<double>, errors array<double>")
    null = blocks.groupBy(key).agg(
        F.max("n_sampled").alias("n_sampled"), F.flatten(F.collect_list("ratios")).alias("_ratios"), F.flatten(F.collect_list("errors")).alias("_errors"))
    inside, outside = F.col("region") == "interface", F.col("region") == "surface"
    observed = positions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_residues"), F.count_if(inside).alias("n_interface"), F.count_if(outside).alias("n_surface_pool"),
        F.sum(F.when(inside, F.col("slope"))).alias("_sum"), F.avg(F.when(inside, F.col(area))).alias("mean_area_interface"),
        F.avg(F.when(outside, F.col(area))).alias("mean_area_surface"))
    status = F.when(F.col("n_interface") == 0, "skipped: no interface").when(
        F.col("n_surface_pool") < F.col("n_interface"), "skipped: surface pool smaller than interface").when(
        F.col("n_sampled") == 0, "skipped: areas missing").otherwise("matched")
    return _against_null(observed.join(null, key, "left").withColumn("status", status), key)


def _mean(values: Column, n: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), n)


def _against_null(joined: DataFrame, key: str) -> DataFrame:
    n = F.nullif(F.size("_ratios"), F.lit(0)).cast("double")
    df = joined.withColumn("n_draws", F.size("_ratios").cast("bigint")).withColumn("null_mean_ratio", _mean(F.col("_ratios"), n))
    squares = F.aggregate("_ratios", F.lit(0.0), lambda a, v: a + (v - F.col("null_mean_ratio")) * (v - F.col("null_mean_ratio")))
    matched = F.col("status") == "matched"
    df = df.withColumn("null_sd_ratio", F.sqrt(F.try_divide(squares, n - 1))).withColumn(
        "observed_ratio", F.when(matched, F.col("_sum") / (F.col("n_interface") / F.col("n_residues"))))
    gap = F.abs(F.col("observed_ratio") - F.col("null_mean_ratio"))
    extreme = F.size(F.filter("_ratios", lambda v: F.abs(v - F.col("null_mean_ratio")) >= gap))
    return df.withColumn("p_permutation", F.when(matched, (extreme + 1) / (n + 1))).withColumn(
        "mean_match_error", _mean(F.col("_errors"), n)).withColumn(
        "observed_minus_null", F.col("observed_ratio") - F.col("null_mean_ratio")).select(
        key, "status", "n_residues", "n_interface", "n_surface_pool", "n_sampled", "n_draws", "mean_area_interface", "mean_area_surface",
        "observed_ratio", "null_mean_ratio", "null_sd_ratio", "observed_minus_null", "p_permutation", "mean_match_error")
