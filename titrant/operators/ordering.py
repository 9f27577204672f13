"""Order statistics that never gather a whole group in one task.

A window over one hot group, or an exact `percentile` over it, would hold that group in a single
task. Here values are first counted per distinct value, then cut into ranges (or hash prefixes), so
a group spreads over many tasks; only one total per range is added up in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from titrant.session import keep, shared_root

RANGES = 64
# A group of this many distinct values is left to one window.
LARGEST = 250_000
# Up to this many distinct values in all, one window per group is cheaper than cutting into ranges.
SMALL = 1_000_000


def split_points(counts: DataFrame, column: str = "value", ranges: int = RANGES) -> list[float]:
    """Cut values over the distinct values of a kept table; none when they are few enough for one
    window per group.

    Read once, so every later stage uses the same cuts, and of fixed length whatever the table
    size. Any cuts give right answers; close to even ones only balance the work.
    """
    if counts.count() <= SMALL:
        return []
    fractions = [i / ranges for i in range(1, ranges)]
    row = counts.agg(
        F.percentile_approx(F.col(column).cast("double"), fractions, 2000).alias("p")
    ).first()
    return sorted(set(row["p"]))


def range_of(column: Column, points: Sequence[float]) -> Column:
    """Index of the range a value falls in: how many cut values lie below it."""
    cuts = F.array(*[F.lit(float(p)) for p in points])
    return F.size(F.filter(cuts, lambda p: p < column))


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, weight): ties collapse map-side, so a popular value costs one row."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def running_weight(counts: DataFrame, groups: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Adds `before` (weight of smaller values in the group) and `total` (weight of the group)."""
    if not points:
        group = W.partitionBy(*groups)
        return counts.withColumn(
            "before", F.sum("weight").over(group.orderBy("value")) - F.col("weight")
        ).withColumn("total", F.sum("weight").over(group))
    ranged = counts.withColumn("_range", range_of(F.col("value").cast("double"), points))
    totals = ranged.groupBy(*groups, "_range").agg(F.sum("weight").alias("_in_range"))
    # One row per group and range, so at most RANGES rows per group meet in this window.
    in_order = W.partitionBy(*groups).orderBy("_range")
    offsets = totals.select(
        *groups,
        "_range",
        (F.sum("_in_range").over(in_order) - F.col("_in_range")).alias("_offset"),
        F.sum("_in_range").over(W.partitionBy(*groups)).alias("total"),
    )
    inside = W.partitionBy(*groups, "_range").orderBy("value")
    return (
        ranged.withColumn("_inside", F.sum("weight").over(inside) - F.col("weight"))
        .join(offsets, [*groups, "_range"])
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def positions(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    counts = keep(value_counts(df, groups, value))
    return running_weight(counts, groups, split_points(counts, "value"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, rank): ties share the mean of the ranks they span."""
    ranked = positions(df, groups, value)
    return ranked.select(
        *groups, "value", (F.col("before") + (F.col("weight") + 1) / 2).alias("rank")
    )


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which a null key meets a null key, as groups do."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def selected(df: DataFrame, groups: Sequence[str], value: str, places: Callable[[Column], list[Column]]) -> DataFrame:
    """(groups, value, weight, before, total, greatest): the part of each group's values in which its
    wanted places lie, given from the group's total weight; the places of the rest are known.

    While the largest group left is too large for one window, a histogram of its values says how much
    weight lies in each range and so which ranges hold a wanted place; all other ranges go, and the
    weight before them is kept as one number. Each round keeps about a thirtieth of what there was.
    """
    counts = value_counts(df, groups, value)
    if not groups:
        counts, groups = counts.withColumn("_all", F.lit(0)), ["_all"]
    counts = keep(counts)
    totals = counts.groupBy(*groups).agg(F.sum("weight").alias("total"), F.max("value").alias("greatest"))
    now = _joined(counts, totals, groups).withColumn("_base", F.lit(0).cast("bigint"))
    while (now.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0) > LARGEST:
        points = now.agg(F.percentile_approx(F.col("value").cast("double"), [i / RANGES for i in range(1, RANGES)], 2000)).first()[0]
        ranged = now.withColumn("_range", range_of(F.col("value").cast("double"), sorted(set(points))))
        sums = ranged.groupBy(*groups, "_base", "_range").agg(F.sum("weight").alias("_w"), F.max("total").alias("_total"))
        # One row per range of a part, and a group has no more parts than wanted places.
        in_order = W.partitionBy(*groups, "_base").orderBy("_range")
        low = F.col("_base") + F.sum("_w").over(in_order) - F.col("_w")
        placed = sums.withColumn("_low", low)
        hit = F.lit(False)
        for place in places(F.col("_total")):
            hit = hit | ((F.col("_low") <= place) & (place < F.col("_low") + F.col("_w")))
        wanted = placed.where(hit).select(*groups, "_base", "_range", "_low")
        fewer = keep(_joined(ranged, wanted, [*groups, "_base", "_range"]).drop("_base", "_range").withColumnRenamed("_low", "_base"))
        if fewer.count() == now.count():
            break
        now = fewer
    inside = W.partitionBy(*groups, "_base").orderBy("value")
    return now.withColumn("before", F.col("_base") + F.sum("weight").over(inside) - F.col("weight")).drop("_base")


def _at(position: Column) -> Column:
    """The value standing at a zero-based sorted position; one row per group satisfies it."""
    hit = (F.col("before") <= position) & (position < F.col("before") + F.col("weight"))
    return F.max(F.when(hit, F.col("value").cast("double")))


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of `wanted`."""
    place = lambda total, q: (total - 1) * F.lit(float(q))
    both = lambda total: [f(place(total, q)) for q in wanted.values() for f in (F.floor, F.ceil)]
    ranked = selected(df, groups, value, both)
    columns = []
    for name, q in wanted.items():
        at = place(F.col("total"), q)
        columns += [
            _at(F.floor(at)).alias(f"_lo_{name}"),
            _at(F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_part_{name}"),
        ]
    got = ranked.groupBy(*groups).agg(*columns) if groups else ranked.agg(*columns)
    return got.select(
        *groups,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")
            ).alias(n)
            for n in wanted
        ],
    )


def medians(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Interpolated median of several columns per group: (groups, name, median).

    The columns go long first, so all of them share one pass and one set of shuffles.
    """
    stacked = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("measure"))
                for v in values
            ]
        )
    )
    long = df.select(*groups, stacked.alias("_cell")).select(*groups, "_cell.name", "_cell.measure")
    return quantiles(long, [*groups, "name"], "measure", {"median": 0.5})


def upper_median(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, upper_median, max): the element at place n div 2, never an average of two."""
    place = lambda total: F.floor(total / 2)
    ranked = selected(df, groups, value, lambda total: [place(total)])
    columns = [_at(place(F.col("total"))).alias("upper_median"), F.max(F.col("greatest").cast("double")).alias("max")]
    return ranked.groupBy(*groups).agg(*columns) if groups else ranked.agg(*columns)


def hash_order(*parts: Column) -> Column:
    """Text whose order is uniform and reproducible in any engine with md5."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def hash_index(
    df: DataFrame, groups: Sequence[str], key: Column, width: int = 3, small: bool = False
) -> DataFrame:
    """Dense zero-based `slot` per group in order of `key` (an md5 text), and group size `n`.

    Work splits by the first `width` hex digits, so a group of any size spreads over 16**width
    tasks; raising `width` changes the split but not the order. `small` is for groups whose size
    the caller has checked: the same numbering from one plain window.
    """
    if small:
        group = W.partitionBy(*groups)
        return (
            df.withColumn("_key", key)
            .withColumn("slot", (F.row_number().over(group.orderBy("_key")) - 1).cast("bigint"))
            .withColumn("n", F.count(F.lit(1)).over(group))
            .drop("_key")
        )
    keyed = df.withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, width))
    totals = keyed.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("_in_prefix"))
    in_order = W.partitionBy(*groups).orderBy("_prefix")
    offsets = totals.select(
        *groups,
        "_prefix",
        (F.sum("_in_prefix").over(in_order) - F.col("_in_prefix")).alias("_offset"),
        F.sum("_in_prefix").over(W.partitionBy(*groups)).alias("n"),
    )
    inside = W.partitionBy(*groups, "_prefix").orderBy("_key")
    return (
        keyed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*groups, "_prefix"])
        .withColumn("slot", F.col("_inside") + F.col("_offset"))
        .drop("_key", "_prefix", "_inside", "_offset")
    )


def ordered_index(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Zero-based place of every row in a total order over the whole table.

    A range-partitioned sort written to the checkpoint folder fixes which row is where; after that
    only one count per partition is added up. Nothing passes through a single task.
    """
    shared_root(df.sparkSession)
    fixed = df.orderBy(*order).checkpoint()
    tagged = fixed.withColumn("_row", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_row", 33))
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_part",
        (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_offset"),
    )
    inside = F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return (
        tagged.join(offsets, "_part")
        .withColumn(name, inside + F.col("_offset"))
        .drop("_row", "_part", "_offset")
    )
