"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.llm.shared import NO_ID, back_to_id, row_id, written

#: Lower-cased words: runs of digits, letters and characters beyond ASCII.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Item windows are sent to every task in blocks of at most this many bytes and rows.
BLOCK_BYTES, BLOCK_ROWS = 16_000_000, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with case kept; an empty one can stand first and last. Splitting is all
    that is done to a whole text, so that words stream through compiled code."""
    return F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def exact_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and nothing else changed."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), lambda w: w != "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window): 10 consecutive words of each item, or all words of a shorter one. Items without
    an id have windows like others; only lists of items leave them out."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), exact_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return (
        items.where("size(w) > 0")
        .select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("window"))
        .distinct()
    )


def _blocks(df: DataFrame, size: Column) -> tuple[DataFrame, int]:
    """`df` with a block number, so that each block keeps within the bytes and rows of a broadcast."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    n = max(1, -(-total["n"] // BLOCK_ROWS), -(-int(total["bytes"] or 0) // BLOCK_BYTES))
    return df.withColumn("block", F.pmod(F.xxhash64(*df.columns), F.lit(n))), n


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, th, item, at, span): each place where a window of an item occurs in a text, exactly.

    A text that contains a window contains its rarest word, so one word per window is the prefix
    that a containment join needs. Rarity is counted over all texts. Words of texts stream past a
    broadcast block of windows keyed by that word, and never move; where one fits, the length bound
    and the position of the word in its window fix the only place the window can stand, and the
    words there are compared exactly.
    """
    texts = docs.select(row_id().alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).where("text is not null")
    windows = written(item_windows(benchmark), "leak-windows")
    vocabulary, blocks = _blocks(
        windows.select(F.explode("window").alias("word")).select(F.lower("word").alias("word")).distinct(), F.octet_length("word")
    )
    vocabulary = written(vocabulary, "leak-words")
    # lower() folds letters beyond A-Z too: words that are equal by the contract stay equal, and what
    # passes is compared exactly afterwards.
    words = texts.select(F.explode(words_of(F.col("text"))).alias("w")).select(F.lower("w").alias("word"))
    counted = None
    for block in range(blocks):
        part = words.join(F.broadcast(vocabulary.where(F.col("block") == block).select("word")), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        counted = part if counted is None else counted.unionByName(part)
    counted = written(counted, "leak-counts")

    # The rarest word of each window; a window with a word that no text has can occur nowhere.
    ranked = (
        windows.withColumn("wid", F.xxhash64("item", "window"))
        .select("wid", "item", "window", F.posexplode("window").alias("offset", "exact"))
        .select("wid", "item", "window", "offset", F.lower("exact").alias("word"))
        .join(counted, "word", "left")
        .groupBy("wid", "item", "window")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "offset")).alias("rare"))
        .where("rare.df > 0")
        .select("item", "window", "rare.word", "rare.offset")
    )
    keyed, blocks = _blocks(ranked, F.octet_length(F.concat_ws(" ", "window")) + 40)
    keyed = written(keyed, "leak-rare")
    found = None
    source = texts.select("id", "th", words_of(F.col("text")).alias("ws"))
    placed = source.select("id", "th", "ws", F.posexplode("ws").alias("place", "w")).withColumn("word", F.lower("w"))
    for block in range(blocks):
        near = placed.join(F.broadcast(keyed.where(F.col("block") == block).drop("block")), "word")
        at = F.col("place") - F.col("offset")
        there = F.array_join(F.slice("ws", F.greatest(at + 1, F.lit(1)), F.size("window")), " ")
        part = (
            near.where(at >= 0).where(at + F.size("window") <= F.size("ws"))
            .where(F.translate(there, _UPPER, _LOWER) == F.array_join("window", " "))
            .select("id", "th", "item", at.alias("at"), F.size("window").alias("span"))
        )
        found = part if found is None else found.unionByName(part)
    return found


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, th, n_hit, n_items, items_sha256) for each text that holds a window of an item."""
    hits = written(occurrences(docs, benchmark), "leak-hits")
    items = hits.groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = hits.select("id", "th", "at", "span").distinct().groupBy("id", "th").agg(
        F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("span")).alias("end")))).alias("spans")
    )
    # Spans in order: each adds what reaches beyond the furthest end so far.
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        "spans", start,
        lambda acc, s: F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["reach"], s["at"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    return items.join(spans, ["id", "th"]).select(
        "id", "th", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: words, words inside a benchmark window, items, and the verdict.

    A null or wordless text has no words and no hits; items with a null or wordless text match
    nothing; windows of items without an id are hits and count as no item; items of fewer than 10
    words count as one window; repeated rows and ids each get their row; long texts stream word by
    word; an empty benchmark leaves every text clean; other columns are not read.
    """
    found = judged(docs, benchmark)
    sizes = docs.select(row_id().alias("id"), F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint").alias("n_words"))
    return sizes.join(found, ["id", "th"], "left").select(
        back_to_id("id").alias("doc_id"), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any window of a benchmark item, all columns kept."""
    bad = judged(docs, benchmark).select("id", "th")
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(bad, ["id", "th"], "left_anti").select("row.*")
