"""Work lists: what is left to do, in what order, and how it went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from titrant.operators.ordering import medians, ordered_index, upper_median


def outstanding(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def scope_reason(done: Column, size: Column, low: int, high: int, beta: Column, doses: Sequence[float]) -> Column:
    return (
        F.when(done, "done").when(size < low, "too small").when(size > high, "too large")
        .when(~beta.isin(*doses), "dose not wanted").otherwise("kept"))


def largest_first(jobs: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """The n largest first, the rest by key. Only n keys are compared with the whole list."""
    if n < 0:
        raise ValueError(f"n must not be negative, got {n}")
    order = [F.col(size).desc(), F.col(key)]
    top = jobs.orderBy(*order).limit(n).select(key, F.row_number().over(W.orderBy(*order)).alias("lead_rank"))
    marked = jobs.join(top, key, "left")
    return marked.orderBy(F.coalesce("lead_rank", F.lit(n + 1)), key)


def spaced_sample(jobs: DataFrame, complex_key: str, size: str, dose: str, tie: str, n: int = 4, each: int = 2) -> DataFrame:
    """Complexes at even steps of the size order, the largest always, and the doses nearest 0 of each."""
    if n < 1 or each < 1:
        raise ValueError(f"need at least one complex and one dose, got {n} and {each}")
    sizes = jobs.groupBy(complex_key).agg(F.max(size).alias("_size"))
    ranked = ordered_index(sizes, [F.col("_size"), F.col(complex_key)])
    total = ranked.count()
    if total == 0:
        return jobs.limit(0)
    n = min(n, total)
    # Half-even rounding of the step positions; n is a parameter, so this list is short.
    places = {round(i * (total - 1) / (n - 1)) for i in range(n)} if n > 1 else set()
    places.add(total - 1)
    picked = ranked.where(F.col("position").isin(*sorted(places))).select(complex_key)
    order = W.partitionBy(complex_key).orderBy(F.abs(dose), dose, tie)
    chosen = jobs.join(picked, complex_key).withColumn("_r", F.row_number().over(order))
    return chosen.where(F.col("_r") <= each).drop("_r")


def trailing_failures(jobs: DataFrame, groups: Sequence[str], order: str, failed: str) -> DataFrame:
    """(groups, n, n_failed, trailing): failures after the last success, from two aggregates."""
    last = jobs.groupBy(*groups).agg(F.max(F.when(~F.col(failed), F.col(order))).alias("_last"))
    after = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
    return jobs.join(last, list(groups)).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(after).alias("trailing"))


def stop_verdict(runs: DataFrame, max_run: int = 4, max_rate: float = 0.5, min_attempts: int = 8) -> DataFrame:
    rate = F.try_divide("n_failed", "n")
    return runs.withColumn(
        "verdict", F.when(F.col("trailing") >= max_run, "stop: consecutive failures")
        .when((F.col("n") >= min_attempts) & (rate > max_rate), "stop: failure rate").otherwise("continue"))


def wave_of(beta: Column, waves: Sequence[Sequence[float]]) -> Column:
    """Index of the first wave that lists the dose; whatever no wave lists goes last."""
    out = None
    for i, doses in enumerate(waves):
        hit = F.round(beta, 6).isin(*[round(float(d), 6) for d in doses])
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.lit(0) if out is None else out.otherwise(len(waves))


def chunks(jobs: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    return ordered_index(jobs, order).withColumn("chunk", F.floor(F.col("position") / size))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), reason)


def first_failures(jobs: DataFrame, group: str, failed: str, order: str, label: Column, show: int = 5) -> DataFrame:
    w = W.partitionBy(group).orderBy(order)
    top = jobs.where(failed).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= show)
    return top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", label.alias("label")))).alias("f")).select(
        group, F.array_join(F.transform("f", lambda x: x["label"]), ",").alias("first_failures"))


def wave_report(jobs: DataFrame, wave: str, failed: str, measures: Sequence[str], order: str, label: Column) -> DataFrame:
    stats = jobs.groupBy(wave).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if(~F.col(failed)).alias("n_succeeded"), F.count_if(failed).alias("n_failed"))
    stats = stats.withColumn("success_rate", F.coalesce(F.try_divide("n_succeeded", "n_jobs"), F.lit(0.0)))
    m = medians(jobs.where(~F.col(failed)), [wave], measures).groupBy(wave).pivot("name", list(measures)).agg(F.first("median"))
    m = m.withColumnsRenamed({c: f"median_{c}" for c in measures})
    return stats.join(m, wave, "left").join(first_failures(jobs, wave, failed, order, label), wave, "left")


def first_and_repeat(jobs: DataFrame, complex_key: str, order: Sequence[str], measure: str) -> DataFrame:
    """Median of the first timed job of each complex and of the later ones; without later ones the
    first stand in."""
    timed = jobs.where(F.col(measure).isNotNull())
    first = timed.groupBy(complex_key).agg(F.min(F.struct(*order)).alias("_first"))
    marked = timed.join(first, complex_key).withColumn(
        "kind", F.when(F.struct(*order) == F.col("_first"), "first").otherwise("repeat"))
    m = medians(marked, ["kind"], [measure]).agg(
        F.max(F.when(F.col("kind") == "first", F.col("median"))).alias("first_median"),
        F.max(F.when(F.col("kind") == "repeat", F.col("median"))).alias("repeat_median"))
    return m.select("first_median", F.coalesce("repeat_median", "first_median").alias("repeat_median"))


def squared_share(jobs: DataFrame, complex_key: str, size: str, limit: int) -> DataFrame:
    """Complexes, jobs and share of squared size at or below the limit, and above it."""
    per = jobs.groupBy(complex_key).agg(F.min(size).alias("s"), F.count(F.lit(1)).alias("jobs"))
    side = F.when(F.col("s") <= limit, "small").otherwise("large")
    w = F.col("s").cast("double") * F.col("s")
    parts = per.groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n_complexes"), F.sum("jobs").alias("n_jobs"), F.sum(w).alias("_w"))
    return parts.withColumn("share", F.col("_w") / F.sum("_w").over(W.partitionBy(F.lit(1)))).drop("_w")  # two rows


def timing_summary(jobs: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Upper median, min and max per group; groups that cannot be compared are never pooled."""
    cells = F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("v")) for m in measures])
    long = jobs.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.name", "c.v").where(F.col("v").isNotNull())
    mid = upper_median(long, [*groups, "name"], "v")
    low = long.groupBy(*groups, "name").agg(F.min("v").alias("min"), F.count(F.lit(1)).alias("n"))
    return low.join(mid, [*groups, "name"])


def replace_columns(df: DataFrame, key: Sequence[str], new: DataFrame) -> DataFrame:
    """Append computed columns by key, in place of older ones of the same name."""
    fresh = [c for c in new.columns if c not in key]
    return df.drop(*fresh).join(new, list(key), "left")


def job_list(designs: DataFrame, test_set: DataFrame, definitions: DataFrame) -> DataFrame:
    """designs(pdb_id, designed_chain[], ...) with listed chains and native sequences looked up.

    Rows that cannot become a job keep an error kind instead of vanishing. definitions holds one
    row per (pdb_id, chain, native_seq).
    """
    designed = F.get("designed_chain", 0)
    known = definitions.select("pdb_id").distinct().withColumn("_defined", F.lit(True))
    rows = designs.join(test_set.select("pdb_id", "chains"), "pdb_id", "left").join(known, "pdb_id", "left")
    rows = rows.withColumn("partner", F.get(F.filter("chains", lambda c: c != designed), 0))
    native = definitions.select("pdb_id", F.col("chain").alias("partner"), "native_seq")
    rows = rows.join(native, ["pdb_id", "partner"], "left")
    error = (
        F.when(F.size("designed_chain") != 1, "more than one designed chain")
        .when(F.col("chains").isNull() | F.col("_defined").isNull(), "entry not listed or not defined")
        .when(F.col("partner").isNull(), "no partner chain").when(F.col("native_seq").isNull(), "no native sequence"))
    return rows.withColumn("error", error).withColumn(
        "chain_map", F.when(error.isNull(), F.map_from_arrays(F.array(designed, "partner"), F.array("sequence", "native_seq")))
    ).withColumn("mode_map", F.when(error.isNull(), F.map_from_arrays(F.array(designed, "partner"), F.array(F.lit("single_sequence"), F.lit("msa"))))).drop("_defined")
