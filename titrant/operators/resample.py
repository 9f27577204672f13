"""Bootstrap and permutation inference over units, reproducible on any partitioning.

A draw is a hash of (seed, group, replicate, slot), so it depends on no generator state and no
partition layout. Where the values of the largest group fit into a task (counted, not assumed), each
task draws a block of replicates of one group over an array of its values, and only one number per
replicate leaves it; a statistic given as a column aggregate gets the drawn values as rows, which
combine in that task. Beyond that, draws are rows that are joined by slot; all ways give the same
numbers.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from titrant.operators.ordering import hash_index, hash_order, quantiles
from titrant.session import keep

# Units of the largest group up to which its values, 8 bytes each, are sent to every block of draws.
BROADCAST_UNITS = 10_000_000
# A unit row is a few dozen bytes; this many stay well under the broadcast limit.
JOIN_UNITS = 1_000_000
# Draws of one block, the most blocks that a group's values are sent to, and the tasks that are enough.
BLOCK_DRAWS, BLOCKS, TASKS = 20_000_000, 64, 256
# Units whose values travel as one row, rows of draws that leave a task at once, and numbers that are
# hashed while they are in the processor's cache.
PACKED, EMITTED, CACHED = 1 << 18, 1 << 18, 1 << 14
#: Constants of the draw hash: a prime below 2**31, two multipliers, and the offset of replicates.
PRIME, TIMES_1, TIMES_2, REPLICATE = 2_147_483_647, 1_103_515_245, 1_812_433_253, 1_000_003


def _tag(seed: int, groups: Sequence[str]) -> list[Column]:
    return [F.lit(str(seed)), *[F.col(g) for g in groups if g != "_all"]]


def _grouped(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The whole table as one named group, so grouped and pooled runs share one plan shape."""
    return (df, list(groups)) if groups else (df.withColumn("_all", F.lit(0)), ["_all"])


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Over all cores before rows multiply; the rows moved are units, not draws."""
    sc = df.sparkSession.sparkContext
    width = max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, *columns)


def with_slots(df: DataFrame, groups: Sequence[str], unit: str, seed: int) -> DataFrame:
    key = hash_order(*_tag(seed, groups), F.col(unit))
    return hash_index(df, groups, key)


def _mix(part: np.ndarray, spare: np.ndarray) -> None:
    """`mixed` in place, of an array that fits the cache and another one of its length."""
    for times, shift, subtracted in ((TIMES_1, 15, 2), (TIMES_2, 13, 1)):
        part *= np.uint64(times)
        np.right_shift(part, np.uint64(31), out=spare)  # the prime is 2**31 - 1, so the high bits are added to the low ones
        part &= np.uint64(PRIME)
        part += spare
        for _ in range(subtracted):
            np.subtract(part, np.uint64(PRIME), out=spare)
            np.minimum(part, spare, out=part)
        np.right_shift(part, np.uint64(shift), out=spare)
        part ^= spare


def mixed(x):
    """A hash of integers from 0 to 2**32 to integers below 2**31, as a column or on an array.

    Multiplication modulo a prime and xor with a shifted copy, twice: 64-bit integers hold every
    step, so any engine gives the same value.
    """
    if not isinstance(x, Column):
        out = np.array(x, np.uint64)
        flat = out.reshape(-1)
        spare = np.empty(min(flat.size, CACHED), np.uint64)
        for low in range(0, flat.size, CACHED):
            part = flat[low : low + CACHED]
            _mix(part, spare[: len(part)])
        return out.view(np.int64)
    x = x.cast("bigint") * F.lit(TIMES_1).cast("bigint") % F.lit(PRIME).cast("bigint")
    x = x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(TIMES_2).cast("bigint") % F.lit(PRIME).cast("bigint")
    return x.bitwiseXOR(F.shiftright(x, 13))


def group_key(groups: Sequence[str], seed: int) -> Column:
    """A number below 2**28 for the seed and the group."""
    return F.conv(F.substring(hash_order(*_tag(seed, groups)), 1, 7), 16, 10).cast("bigint")


def _draw_columns(groups: Sequence[str], seed: int) -> Column:
    """The draw hash of columns `rep` and `slot`."""
    return mixed(mixed(F.col("slot") + group_key(groups, seed)) + mixed(F.col("rep") + REPLICATE))


def draws(slots: DataFrame, groups: Sequence[str], n_resamples: int, seed: int) -> DataFrame:
    """(groups, rep, pick): n picks with replacement per replicate."""
    each = spread(slots.select(*groups, "slot", "n"), *groups, "slot").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)))
    )
    return each.select(*groups, "rep", F.pmod(_draw_columns(groups, seed), F.col("n")).alias("pick"))


def picked(hashes: np.ndarray) -> np.ndarray:
    """The picks of one replicate: its hashes modulo the number of units."""
    n, out = np.uint64(len(hashes)), hashes.view(np.uint64).copy()
    for low in range(0, out.size, CACHED):
        part = out[low : low + CACHED]
        part -= part // n * n  # division by one number is vectorised, the remainder is not
    return out.view(np.int64)


def drawn_mean(base: np.ndarray, shift: int, values: np.ndarray, out: np.ndarray) -> float:
    """The mean of one replicate, `values[picked(mixed(base + shift))].mean()`: from hash to value while
    a part is in the cache, so that of an array that is not only its values are read at random."""
    n, base = np.uint64(len(values)), base.view(np.uint64)
    part, spare = np.empty((2, min(len(values), CACHED)), np.uint64)
    for low in range(0, len(values), CACHED):
        high = min(low + CACHED, len(values))
        x, y = part[: high - low], spare[: high - low]
        np.add(base[low:high], np.uint64(shift), out=x)
        _mix(x, y)
        np.floor_divide(x, n, out=y)
        y *= n
        x -= y
        np.take(values, x.view(np.int64), out=out[low:high], mode="clip")  # no pick is clipped; `raise` would copy
    return out.mean()


def _sizes(slots: DataFrame, groups: Sequence[str]) -> tuple[int, int]:
    """The units of all groups, and those of the largest."""
    row = slots.groupBy(*groups).agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m"), F.max("m")).first()
    return row[0] or 0, row[1] or 0


def _packed(slots: DataFrame, groups: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """Values in the order of their slots, as bytes: a row for each PACKED units of a group."""
    first = [*groups, "_part", "_key"]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slot")
        out = rows.slice(0, 1).select(first)
        for c in columns:
            out = out.append_column(c, pa.array([rows[c].to_numpy().tobytes()], pa.binary()))
        return out

    parts = slots.select(*groups, "slot", *columns, group_key(groups, seed).alias("_key"), F.floor(F.col("slot") / PACKED).alias("_part"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*first).schema)
    return parts.groupBy(*groups, "_part").applyInArrow(pack, ", ".join([shape, *(f"`{c}` binary" for c in columns)]))


def in_blocks(
    slots: DataFrame, groups: Sequence[str], columns: Sequence[str], n_resamples: int, seed: int, sizes: tuple[int, int],
    kernel: Callable[[np.ndarray, list[np.ndarray]], float] | None, prepare: Callable[[np.ndarray], np.ndarray] | None = None,
    first: int = 0,
) -> DataFrame:
    """(groups, rep, stat): `kernel(hashes, values)` for each replicate from `first` on, where hashes
    holds one number per slot and values the given columns by slot, each passed through `prepare`;
    `drawn_mean` hashes by itself. Without a kernel (groups, rep, v): all drawn values of the first column."""
    units, largest = sizes
    alike = -(-units // max(largest, 1))  # as many groups of the largest size would hold all units
    wanted, means = n_resamples - first, kernel is drawn_mean
    n_blocks = int(np.clip(min(-(-largest * wanted // BLOCK_DRAWS), -(-TASKS // max(alike, 1))), 8, min(BLOCKS, wanted)))
    kinds = {c: np.float64 if t == "double" else np.int64 for c, t in slots.select(*columns).dtypes}
    each = _packed(slots, groups, columns, seed).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def batch(named: list[pa.Scalar], rep: np.ndarray, found: np.ndarray, label: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.repeat(g, len(found)) for g in named), pa.array(rep, pa.int32()), pa.array(found, pa.float64())], [*groups, "rep", label])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("_part")
        values = [np.concatenate([np.frombuffer(x.as_buffer(), kinds[c]) for x in rows[c]]) for c in columns]
        base = mixed(np.arange(len(values[0])) + rows["_key"][0].as_py())
        named, block = [rows[g][0] for g in groups], rows["_block"][0].as_py()
        del rows
        values = [prepare(v) for v in values] if prepare else values
        reps = np.arange(first + block, n_resamples, n_blocks)
        if means:
            out = np.empty(len(base))
            yield batch(named, reps, np.array([kernel(base, h, values[0], out) for h in mixed(reps + REPLICATE)], float), "stat")
            return
        drawn = (mixed(base + h) for h in mixed(reps + REPLICATE))
        if kernel:
            yield batch(named, reps, np.array([kernel(hashes, values) for hashes in drawn], float), "stat")
            return
        for rep, hashes in zip(reps, drawn, strict=True):
            found = values[0][picked(hashes)]
            for low in range(0, len(found), EMITTED):
                part = found[low : low + EMITTED]
                yield batch(named, np.full(len(part), rep), part, "v")

    label = "stat" if kernel else "v"
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slots.select(*groups).schema)
    found = spread(each, *groups, "_block").groupBy(*groups, "_block").applyInArrow(run, f"{shape}, rep int, {label} double")
    return found.withColumn("stat", F.nanvl("stat", F.lit(None).cast("double"))) if kernel else found


def _values_for(slots: DataFrame, columns: Sequence[str], units: int) -> DataFrame:
    values = slots.select(*columns)
    return F.broadcast(values) if units <= min(JOIN_UNITS, BROADCAST_UNITS) else values


def _complete(df: DataFrame, columns: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """The few columns needed, without missing measures. Kept before the filter: pushed below a
    costly expression, a null test would evaluate it a second time for every row."""
    narrow = keep(df.select(*columns, *[F.col(c).cast("double").alias(name) for name, c in measures.items()]))
    return narrow.dropna(subset=list(measures))


Statistic = str | Callable[[Column], Column]


_KERNELS = {
    "mean": drawn_mean,
    "median": lambda hashes, values: np.median(values[0][picked(hashes)], overwrite_input=True),
}


def _aggregate(df: DataFrame, groups: Sequence[str], statistic: Statistic) -> DataFrame:
    if statistic == "median":
        return quantiles(df, groups, "v", {"stat": 0.5})
    build = F.avg if statistic == "mean" else statistic
    return df.groupBy(*groups).agg(build(F.col("v")).alias("stat"))


def replicates(
    df: DataFrame, groups: Sequence[str], value: str, unit: str, n_resamples: int, seed: int,
    statistic: Statistic = "mean",
) -> tuple[DataFrame, DataFrame]:
    """(slots, replicate statistics). `statistic` is 'mean', 'median' or any column aggregate."""
    kept = _complete(df, [*groups, unit], {"v": value})
    # Slots feed the draws, the lookup and the point estimate: kept so their input runs once.
    slots = keep(with_slots(kept, groups, unit, seed).drop(unit))
    units, largest = sizes = _sizes(slots, groups)
    if largest <= BROADCAST_UNITS:
        kernel = None if callable(statistic) else _KERNELS[statistic]
        stats = in_blocks(slots, groups, ["v"], n_resamples, seed, sizes, kernel)
        return slots, stats if kernel else _aggregate(stats, [*groups, "rep"], statistic)
    picks = draws(slots, groups, n_resamples, seed)
    values = _values_for(slots.withColumnRenamed("slot", "pick"), [*groups, "pick", "v"], units)
    joined = picks.join(values, [*groups, "pick"])
    return slots, _aggregate(joined, [*groups, "rep"], statistic)


def percentile_interval(stats: DataFrame, groups: Sequence[str], confidence: float) -> DataFrame:
    """Low and high over one row per replicate, so at most the number of resamples per group."""
    tail = (1.0 - confidence) / 2.0
    pair = F.percentile(F.col("stat"), F.array(F.lit(tail), F.lit(1.0 - tail)))
    return stats.where(F.col("stat").isNotNull()).groupBy(*groups).agg(
        pair.alias("_p"), F.count(F.lit(1)).alias("n_resamples")
    ).select(*groups, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "n_resamples")


def excludes_zero() -> Column:
    """Strict on both sides: an interval that touches 0 does not exclude it."""
    return (F.col("low") > 0) | (F.col("high") < 0)


def bootstrap_interval(
    df: DataFrame, groups: Sequence[str], value: str, unit: str, *, n_resamples: int = 10_000,
    confidence: float = 0.95, seed: int = 0, statistic: Statistic = "mean",
) -> DataFrame:
    """(groups, estimate, low, high, n, n_resamples, excludes_zero), resampling units."""
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"confidence must lie in (0, 1), got {confidence}")
    df, groups = _grouped(df, groups)
    slots, stats = replicates(df, groups, value, unit, n_resamples, seed, statistic)
    point = _aggregate(slots, groups, statistic).withColumnRenamed("stat", "estimate")
    sizes = slots.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    interval = percentile_interval(stats, groups, confidence)
    out = point.join(sizes, groups).join(interval, groups).drop("_all")
    return out.withColumn("excludes_zero", excludes_zero())


def paired_interval(df, groups, left: str, right: str, unit: str, **kw) -> DataFrame:
    """Interval of left - right, both resampled together."""
    both = df.withColumn("_difference", F.col(left) - F.col(right))
    return bootstrap_interval(both, groups, "_difference", unit, **kw)


def prefixed(interval: DataFrame, prefix: str, confidence: float = 0.95) -> DataFrame:
    """The five result columns under one prefix."""
    keep = [c for c in interval.columns if c not in ("estimate", "low", "high", "n", "n_resamples", "excludes_zero")]
    return interval.select(
        *keep, F.col("estimate").alias(prefix), F.col("low").alias(f"{prefix}_ci_low"),
        F.col("high").alias(f"{prefix}_ci_high"), F.lit(confidence).alias(f"{prefix}_ci_confidence"),
        F.col("n").alias(f"{prefix}_n"),
    )


# Standard errors below 0 from which a mean is expected to stay below it, and the draws of a first try.
FALLEN, TRIED = -2.0, 1024


@dataclass(eq=False)
class _Group:
    """A group with a mean below 0: its standard score, units, and what has been drawn of it."""

    values: tuple
    name: tuple
    key: tuple
    score: float
    units: int
    slots: DataFrame | None = None
    drawn: int = 0
    stats: list[DataFrame] = field(default_factory=list)
    above: int = 0  # replicates of 0 and more
    below: int = 0  # replicates of 0 and less

    def end(self, n_resamples: int, enough: int) -> int:
        """How many replicates to have next: all where the mean is expected to stay below 0, else as
        many as are expected to hold `enough` of 0 and more."""
        if self.score <= FALLEN:
            return n_resamples
        share, wanted = math.erfc(-self.score / math.sqrt(2)) / 2, TRIED
        while wanted < min(n_resamples, max(1.25 * enough / share, self.drawn + 1)):
            wanted *= 2
        return min(wanted, n_resamples)


def _is(groups: Sequence[str], some: Sequence[_Group]) -> Column:
    return functools.reduce(Column.__or__, (
        functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(groups, g.values, strict=True))) for g in some))


def fallen(
    df: DataFrame, groups: Sequence[str], within: Sequence[str], value: str, unit: str, *, n_resamples: int = 10_000,
    confidence: float = 0.95, seed: int = 0,
) -> DataFrame:
    """(within, fell): whether `bootstrap_interval` has a group with an estimate below 0 whose interval
    excludes 0, for each value of `within`, some of the groups' columns.

    The same draws give the same answer, but those go undrawn that cannot change it. A group whose mean
    is not below 0 needs none. One falls out once it has so many replicates on either side of 0 that no
    order of the rest moves an end of its interval off 0. Where one has fallen, the other groups of its
    kind do not matter, so the one that lies furthest below 0 goes first, up to the last draw. Scores
    choose the order of the work and never an answer.
    """
    kept = _complete(df, [*groups, unit], {"v": value})
    rows = kept.groupBy(*groups).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_sd"), F.count(F.lit(1)).alias("_n")).collect()
    rows = [r for r in rows if all(r[c] is not None for c in groups)]  # a missing group has no interval
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*within).schema)
    named = lambda r, columns: tuple(repr(r[c]) for c in columns)  # noqa: E731, for one name of values that differ from themselves
    answers = {named(r, within): [*(r[c] for c in within), False] for r in rows}
    if max((r["_n"] for r in rows), default=0) > BROADCAST_UNITS:
        summary = bootstrap_interval(kept, groups, "v", unit, n_resamples=n_resamples, confidence=confidence, seed=seed)
        return summary.groupBy(*within).agg(F.bool_or(F.col("excludes_zero") & (F.col("estimate") < 0)).alias("fell"))
    left = []
    for r in rows:
        if r["_mean"] < 0:
            score = r["_mean"] * math.sqrt(r["_n"]) / r["_sd"] if r["_sd"] > 0 else -math.inf
            left.append(_Group(tuple(r[c] for c in groups), named(r, groups), named(r, within), score if score < 0 else -math.inf, r["_n"]))
    tail = (1.0 - confidence) / 2.0
    # So many on one side of 0 hold both values between which an end of the interval is interpolated.
    enough = max(n_resamples - math.floor((n_resamples - 1) * (1.0 - tail)), math.floor((n_resamples - 1) * tail) + 2)
    while left:
        now = []
        for key in {g.key for g in left}:
            some = sorted((g for g in left if g.key == key), key=lambda g: g.score)
            now += some[:1] if some[0].score <= FALLEN else some
        if new := [g for g in now if g.slots is None]:
            slots = keep(with_slots(kept.where(_is(groups, new)), groups, unit, seed).drop(unit))
            for g in new:
                g.slots = slots
        alike: dict[tuple, list[_Group]] = {}
        for g in now:
            alike.setdefault((id(g.slots), g.drawn, g.end(n_resamples, enough)), []).append(g)
        parts = [
            in_blocks(some[0].slots.where(_is(groups, some)), groups, ["v"], end, seed, (sum(g.units for g in some), max(g.units for g in some)), _KERNELS["mean"], first=first)
            for (_, first, end), some in alike.items()
        ]
        stats = keep(functools.reduce(DataFrame.unionByName, parts))
        sides = stats.groupBy(*groups).agg(F.count_if(F.col("stat") >= 0).alias("_above"), F.count_if(F.col("stat") <= 0).alias("_below")).collect()
        found = {named(r, groups): r for r in sides}
        for (_, _, end), some in alike.items():
            for g in some:
                g.drawn, g.above, g.below = end, g.above + found[g.name]["_above"], g.below + found[g.name]["_below"]
                g.stats.append(stats)
        for g in now:
            if g.drawn == n_resamples:
                whole = functools.reduce(DataFrame.unionByName, g.stats).where(_is(groups, [g]))
                answers[g.key][-1] |= not percentile_interval(whole, groups, confidence).where(excludes_zero()).isEmpty()
        left = [g for g in left if not answers[g.key][-1] and g.drawn < n_resamples and min(g.above, g.below) < enough]
    return df.sparkSession.createDataFrame([tuple(a) for a in answers.values()], f"{shape}, fell boolean")


# ---- rank correlation --------------------------------------------------------------------------

def _correlation(x: str, y: str, weight: str | None = None) -> Column:
    """Null instead of an error when a side does not vary."""
    if weight is None:
        return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    w, wx, wy = F.col(weight), F.col(weight) * F.col(x), F.col(weight) * F.col(y)
    n = F.sum(w)
    mx, my = F.sum(wx) / n, F.sum(wy) / n
    cov = F.sum(wx * F.col(y)) / n - mx * my
    vx = F.sum(wx * F.col(x)) / n - mx * mx
    vy = F.sum(wy * F.col(y)) / n - my * my
    return F.try_divide(cov, F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0)))


def _ranked_pairs(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach average ranks of x and y; equal (x, y) pairs are already one weighted row."""
    from titrant.operators.ordering import running_weight, split_points

    out = keep(pairs)
    for side in ("x", "y"):
        counts = pairs.groupBy(*groups, F.col(side).alias("value")).agg(F.sum("weight").alias("weight"))
        ranked = running_weight(counts, groups, split_points(counts, "value"))
        ranks = ranked.select(
            *groups, F.col("value").alias(side),
            (F.col("before") + (F.col("weight") + 1) / 2).alias(f"rank_{side}"),
        )
        out = out.join(ranks, [*groups, side])
    return out


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """(groups, n, rho): average ranks for ties, null under three points or without variation."""
    kept = _complete(df, [*groups], {"x": x, "y": y})
    pairs = kept.groupBy(*groups, "x", "y").agg(F.count(F.lit(1)).alias("weight"))
    return _rho(_ranked_pairs(pairs, groups), groups)


def _rho(ranked: DataFrame, groups: Sequence[str]) -> DataFrame:
    sums = ranked.groupBy(*groups).agg(
        F.sum("weight").alias("n"), _correlation("rank_x", "rank_y", "weight").alias("rho")
    )
    return sums.select(*groups, "n", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"))


def _kernel_rho(rx: np.ndarray, ry: np.ndarray) -> float:
    x, y = rx - rx.mean(), ry - ry.mean()
    spread_ = np.sqrt((x * x).mean()) * np.sqrt((y * y).mean())
    return (x * y).mean() / spread_ if spread_ > 0 else np.nan


def _drawn_rho(hashes: np.ndarray, values: list[np.ndarray]) -> float:
    """Rank correlation of the picked pairs. Values are numbered by order, so the ranks of a draw
    come from counting them, without sorting."""
    picks, ranks = picked(hashes), []
    if len(picks) < 3:
        return np.nan
    for codes in values:
        drawn = codes[picks]
        held = np.bincount(drawn)
        ranks.append((np.cumsum(held) - held + (held + 1) / 2)[drawn])
    return _kernel_rho(*ranks)


def _shuffled_rho(hashes: np.ndarray, values: list[np.ndarray]) -> float:
    """Correlation of the ranks of x with those of y in the order of their hashes, then of slots."""
    order = hashes.view(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    order.sort()
    return _kernel_rho(values[0], values[1][(order & np.uint64(2**32 - 1)).view(np.int64)])


def _numbered(values: np.ndarray) -> np.ndarray:
    """Each value's number in the order of the different values."""
    return np.unique(values, return_inverse=True)[1]


def spearman_interval(
    df, groups, x: str, y: str, unit: str, *, n_resamples=10_000, confidence=0.95, seed=0
) -> DataFrame:
    """Pairs move together; replicates without variation are dropped and the rest counted."""
    df, groups = _grouped(df, groups)
    kept = _complete(df, [*groups, unit], {"x": x, "y": y})
    slots = keep(with_slots(kept, groups, unit, seed).drop(unit))
    sizes = _sizes(slots, groups)
    if sizes[1] <= BROADCAST_UNITS:
        stats = in_blocks(slots, groups, ["x", "y"], n_resamples, seed, sizes, _drawn_rho, _numbered)
    else:
        picks = draws(slots, groups, n_resamples, seed)
        values = slots.withColumnRenamed("slot", "pick").select(*groups, "pick", "x", "y")
        inside = [*groups, "rep"]
        pairs = picks.join(values, [*groups, "pick"]).groupBy(*inside, "x", "y").agg(F.count(F.lit(1)).alias("weight"))
        stats = _rho(_ranked_pairs(pairs, inside), inside).withColumnRenamed("rho", "stat")
    interval = percentile_interval(stats, groups, confidence)
    point = spearman(kept, groups, "x", "y").withColumnRenamed("rho", "estimate")
    return point.join(interval, groups).drop("_all").withColumn("excludes_zero", excludes_zero())


def spearman_permutation(df, groups, x: str, y: str, unit: str, *, n_permutations=10_000, seed=0) -> DataFrame:
    """(groups, n, rho, p): two-sided, add-one. Ranks never change under a shuffle of one side, so
    they are computed once and only the pairing is redone."""
    df, groups = _grouped(df, groups)
    kept = _complete(df, [*groups, unit], {"x": x, "y": y})
    pairs = kept.groupBy(*groups, "x", "y").agg(F.count(F.lit(1)).alias("weight"))
    ranked = _ranked_pairs(pairs, groups)
    observed = _rho(ranked, groups)
    with_ranks = kept.join(ranked.select(*groups, "x", "y", "rank_x", "rank_y"), [*groups, "x", "y"])
    slots = keep(with_slots(with_ranks, groups, unit, seed))
    sizes = _sizes(slots, groups)
    if sizes[1] <= BROADCAST_UNITS:
        stats = in_blocks(slots, groups, ["rank_x", "rank_y"], n_permutations, seed, sizes, _shuffled_rho)
    else:
        inside = [*groups, "rep"]
        each = spread(slots.select(*groups, "slot", "rank_y"), *groups, "slot").withColumn(
            "rep", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
        # The hash, then the slot, as texts whose order is that of the numbers.
        hexed = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
        key = F.concat(hexed(_draw_columns(groups, seed)), F.lower(F.lpad(F.hex("slot"), 16, "0")))
        shuffled = hash_index(each.withColumn("_order", key).drop("slot"), inside, F.col("_order")).select(*inside, "slot", "rank_y")
        paired = shuffled.join(slots.select(*groups, "slot", "rank_x"), [*groups, "slot"])
        stats = paired.groupBy(*inside).agg(_correlation("rank_x", "rank_y").alias("stat"))
    extreme = F.abs("stat") >= F.abs("rho") - 1e-12
    return stats.join(observed, groups).groupBy(*groups).agg(
        F.max("n").alias("n"), F.max("rho").alias("rho"),
        ((F.count_if(extreme) + 1) / (F.lit(n_permutations) + 1)).alias("p"),
    ).drop("_all")
