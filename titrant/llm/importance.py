"""Importance resampling towards a target corpus, with hashed n-grams from one overlapped scan."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from titrant.llm.shared import back_to_id, by_batch, keyed_texts, removed, row_id, written

#: Longest run of words that is a feature, and the number of buckets that features hash to.
MOST_WORDS = 2
BUCKETS = 10_000
#: Documents of fewer words are never drawn; of the others, this many in a hundred are.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Features that are hashed before they are added up, so that a long text needs no more memory.
_AT_ONCE = 1 << 20
_GAPS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _grams(most: int) -> regex.Pattern:
    """A pattern whose overlapped matches begin at every word; group n ends the run of n words, where
    the text has as many. The lookarounds let it begin and end at word borders only."""
    more = ""
    for _ in range(most - 1):
        more = rf"(?: ([^ ]++){more})?+"
    return regex.compile(rf"(?<![^ ])([^ ]++){more}(?![^ ])".encode())


def collapsed(text: str) -> bytes:
    """A-Z lower-cased, every run of separators one space. In UTF-8 no separator is part of a longer
    character, so bytes may be searched."""
    return _GAPS.sub(b" ", text.encode().lower())


def spans(text: str, most: int = MOST_WORDS) -> Iterator[tuple[int, int]]:
    """Where each feature stands in the collapsed text."""
    for match in _grams(most).finditer(collapsed(text), overlapped=True):
        for n in range(1, most + 1):
            if match.end(n) >= 0:
                yield match.start(), match.end(n)


def _added(held: np.ndarray, hashes: array, buckets: int) -> np.ndarray:
    counts = np.bincount(np.frombuffer(hashes, np.uint32) % np.uint32(buckets), minlength=buckets)
    return held + counts if len(held) else counts


def _counted(text: str | None, pattern: regex.Pattern, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the buckets that hold features with how many each holds."""
    line = collapsed(text or "").strip(b" ")
    total, held, hashes = 0, np.zeros(0, np.int64), array("I")
    for match in pattern.finditer(line, overlapped=True):
        # The CRC of a longer run carries on from that of the shorter one.
        spans_ = match.regs
        at, crc = spans_[0][0], 0
        for _, end in spans_[1:]:
            if end < 0:
                break
            crc = crc32(line[at:end], crc)
            hashes.append(crc)
            at = end
        if len(hashes) >= _AT_ONCE:
            total += len(hashes)
            held = _added(held, hashes, buckets)
            hashes = array("I")
    total += len(hashes)
    n_words = line.count(b" ") + 1 if line else 0
    if len(held):
        held = _added(held, hashes, buckets)
        places = np.flatnonzero(held)
        return n_words, total, places, held[places]
    places, counts = np.unique(np.frombuffer(hashes, np.uint32) % np.uint32(buckets), return_counts=True)
    return n_words, total, places, counts


def features(docs: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(id, th, n_words, n_features, bucket, held) for every row: its features counted by bucket.

    No row is wider than the number of buckets, however long its text.
    """

    def scan(batch: pa.RecordBatch):
        pattern = _grams(most)
        found = [_counted(text.as_py(), pattern, buckets) for text in batch["text"]]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(f[2]) for f in found]))).astype(np.int32))
        flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"], batch["th"], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int64))),
            ],
            ["id", "th", "n_words", "n_features", "bucket", "held"],
        )

    return by_batch(keyed_texts(docs), scan, "id bigint, th bigint, n_words bigint, n_features bigint, bucket array<int>, held array<bigint>")


def _totals(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows by bucket. A task sends one row per bucket it has seen."""

    def add(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            place, held = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "held"))
            np.add.at(sums, place, held)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], ["bucket", "n"])

    return found.select("bucket", "held").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: how much likelier the target is to hold a feature of it, as
    floor(1000 * ln(ratio)), each count raised by one."""
    s, t = _totals(source, buckets), _totals(target, buckets)
    counts = (
        source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    )
    whole = counts.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))
    ratio = (F.col("t") + 1) * (F.col("ss") + buckets) / ((F.col("s") + 1) * (F.col("tt") + buckets))
    return counts.join(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def scored(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, th, n_words, n_features, weight, score) for every row of `docs`.

    `weight` is the floored mean gain of its features, 0 without any. `score` adds Gumbel noise from
    a hash of the seed and the id, so the highest scores are a weighted draw without replacement that
    any rerun repeats. A missing id is hashed as an empty one.
    """
    found = written(features(docs, most, buckets), "resample-features")
    wanted = written(features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), most, buckets), "resample-target")
    # One number per bucket: the driver holds `buckets` of them at any size of the tables.
    table = np.zeros(buckets, np.int64)
    for row in gains(found, wanted, buckets).collect():
        table[row.bucket] = row.gain
    removed(wanted)

    def weigh(batch: pa.RecordBatch):
        place, held = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "held"))
        sums = np.concatenate(([0], np.cumsum(table[place] * held)))
        ends = batch["bucket"].offsets.to_numpy() - batch["bucket"].offsets[0].as_py()
        n = batch["n_features"].to_numpy()
        weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "th", "n_words", "n_features")), pa.array(weight)], ["id", "th", "n_words", "n_features", "weight"])

    weighed = by_batch(found, weigh, "id bigint, th bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(back_to_id("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("bigint"))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """`scored` with `rank`: 1, 2, 3... over the drawn rows, null for the others.

    Scores are thousandths of logarithms, so there are some 100,000 different ones at most, whatever
    the number of rows: they are counted, and the running sum over them says how many rows stand
    before each score. Rows are then numbered within their own score only, so no task sorts them all.
    """
    rows = written(scored(docs, target, **options), "resample-scores")
    fit = rows.where(F.col("n_words") >= least_words)
    held = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy(F.col("score").desc())
    steps = written(held.select("score", (F.sum("n").over(up) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all")), "resample-steps")
    within = Window.partitionBy("score").orderBy("id", "n_features", "weight", "th")
    place = F.col("before") + F.row_number().over(within)
    shape = ["id", "th", "n_words", "n_features", "weight", "score"]
    placed = (
        fit.join(F.broadcast(steps), "score").withColumn("place", place)
        .select(*shape, F.when(F.col("place") <= F.expr(f"{percent} * all div 100"), F.col("place")).cast("bigint").alias("rank"))
    )
    short = rows.where(F.col("n_words") < least_words)
    return placed.unionByName(short.select(*shape, F.lit(None).cast("bigint").alias("rank")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of `docs`: features, weight, score and rank.

    Null and empty texts have no features, weight 0, a score, and are never drawn. Ties go to the
    smaller doc_id, a missing one last; repeated rows are drawn one by one. An empty target gives
    gains against nothing, an empty `docs` no rows; other columns are not read.
    """
    return ranked(docs, target).select(back_to_id("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn rows of `docs` with all their columns; exact repeats of a drawn row come along."""
    drawn = ranked(docs, target, percent, least_words, **options).where("rank is not null").select("id", "th").distinct()
    whole = docs.select(F.struct("*").alias("row"), row_id().alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(drawn, ["id", "th"], "left_semi").select("row.*")
