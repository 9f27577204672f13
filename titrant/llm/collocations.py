"""Phrase collocations from one roll-up of the longest word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.llm import kernels
from titrant.llm.shared import by_batch, hash_filter, passing, written

#: Longest phrase, fewest occurrences of one that counts, and phrases reported per language.
LONGEST = 5
LEAST = 100
TOP = 2_000
#: Stands for a missing language.
NO_LANG = "und"
#: Bits of the filter of frequent pairs: 4 MB at any size of the corpus. A full one lets more windows
#: through and changes no count.
FILTER_BITS = 1 << 25
#: Bytes of text that a task works on at once; its arrays take some 40 times as much.
SLAB_BYTES = 1 << 20

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per slab of texts: lower-cased bytes, start and end of each word, whether the next word
    continues the same piece, and the language number of each word, with the languages."""
    langs = batch["lang"].fill_null(NO_LANG).dictionary_encode()
    number = langs.indices.to_numpy(zero_copy_only=False)
    data, offsets = kernels.text_bytes(batch["text"])
    for low, high in kernels.slabs(offsets, SLAB_BYTES):
        cut = offsets[low : high + 1]
        part, cut = _LOWER[data[cut[0] : cut[-1]]], cut - cut[0]
        starts, ends, first = kernels.word_spans(part, cut, _GAPS)
        if not len(starts):
            continue
        # The number of breaks before a place: words with equal numbers stand in one piece.
        breaks = np.concatenate(([0], np.cumsum(_BREAKS[part], dtype=np.int32)), dtype=np.int32)
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
        last = first[1:][first[1:] > first[:-1]] - 1
        goes_on[last] = False
        yield part, starts, ends, goes_on, np.repeat(number[low:high], np.diff(first)), langs.dictionary


def _pair_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word with the next one and the language."""
    of_lang = np.array([int.from_bytes(n.as_py().encode()[:8], "little") for n in names], np.uint64)
    words = kernels.span_hashes(part, starts, ends)
    after = np.zeros_like(words)
    after[:-1] = words[1:]
    return kernels.mix(words * np.uint64(0x9E3779B97F4A7C15) + kernels.mix(after) + of_lang[lang])


def _pairs(batch: pa.RecordBatch):
    for part, starts, ends, goes_on, lang, names in _slabs(batch):
        pairs, n = np.unique(_pair_hashes(part, starts, ends, lang, names)[goes_on].view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["h", "n"])


def frequent_pairs(docs: DataFrame, least: int = LEAST, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of word pairs that occur at least `least` times in their language: one bit per place
    of a hash. It has no false negatives, and its size is fixed by `bits`."""
    seen = by_batch(docs, _pairs, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return hash_filter(seen, bits)


def _words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the words by number."""
    lengths = ends - starts
    inside = np.zeros(len(part) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    flat = part[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    places = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(flat)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def windows(docs: DataFrame, filter_: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(lang, w0, w1, ..., n): the window that begins at each word, equal ones of a slab added up.

    Column k holds the word k places ahead, null from the end of the piece on and behind a pair that
    the filter does not hold: no phrase with such a pair is frequent, so nothing is lost.
    """
    columns = [f"w{k}" for k in range(longest)]

    def scan(batch: pa.RecordBatch):
        for part, starts, ends, goes_on, lang, names in _slabs(batch):
            ids, words = _words(part, starts, ends)
            goes_on &= passing(filter_, _pair_hashes(part, starts, ends, lang, names))
            lead, held = {"lang": lang.astype(np.int32), "w0": ids}, np.ones(len(ids), bool)
            for k in range(1, longest):
                ahead, more = np.full(len(ids), -1, np.int32), np.zeros(len(ids), bool)
                ahead[:-k], more[:-k] = ids[k:], goes_on[k - 1 : len(ids) - 1]
                held &= more
                lead[f"w{k}"] = np.where(held, ahead, np.int32(-1))
            found = pa.table(lead).group_by(list(lead), use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            texts = [names.take(found["lang"].combine_chunks())]
            for c in columns:
                numbers = found[c].combine_chunks().to_numpy()
                texts.append(words.take(pa.array(numbers, mask=numbers < 0)))
            yield pa.RecordBatch.from_arrays([*texts, found["count_all"].combine_chunks()], ["lang", *columns, "n"])

    return by_batch(docs, scan, f"lang string, {', '.join(f'{c} string' for c in columns)}, n bigint")


def _joined(k: int, first: int = 0) -> Column:
    return F.concat_ws(" ", *(f"w{i}" for i in range(first, k)))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, k, words, f): every phrase of up to `longest` words with at least `least` occurrences.
    k = 0 stands for the words of a language altogether.

    Each word starts one window, the longest, and equal windows are counted once. ROLLUP then sums
    them over ever shorter prefixes: the sum over all windows that begin with a phrase is the number
    of its occurrences, so no shorter phrase is ever read from the texts.
    """
    columns = [f"w{k}" for k in range(longest)]
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    filter_ = frequent_pairs(texts, least, bits)
    counted = written(windows(texts, filter_, longest).groupBy("lang", *columns).agg(F.sum("n").alias("n")), "phrase-windows")
    # grouping_id has a bit for every column that is summed over, so it tells a prefix from padding.
    rolled = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("over"))
    k = longest - F.expr("bit_count(over)").cast("int")
    last = F.lit(None).cast("string")
    for i in reversed(range(longest)):
        last = F.when(k == i + 1, F.col(f"w{i}")).otherwise(last)
    frequent = (
        rolled.withColumn("k", k).where("k >= 0 and (k = 0 or f >= %d)" % least)
        .withColumn("last", last).where("k = 0 or last is not null")
        .select("lang", "k", F.array_compact(F.array(*columns)).alias("words"), "f")
    )
    return written(frequent, "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of at least two words that no longer one
    with as many occurrences contains.

    `score` is floor(1000 * a * n / (l * r)) at the cut that makes it least, the first of equal ones;
    it is computed in decimals of 38 digits, which hold 1000 * a * n up to 10**17 words a language.
    """
    return _scored(phrases(docs, least, longest, bits))


def _scored(found: DataFrame) -> DataFrame:
    named = found.withColumn("phrase", F.array_join("words", " "))
    f = named.where("k > 0").select("lang", "phrase", "f")
    candidates = named.where("k > 1").select("lang", "phrase", "words", "k", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("tail"),
    )
    heads = f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    n = found.where("k = 0").select("lang", F.col("f").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(l_r as decimal(38,0))")
    cut = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(n), "lang")
        .withColumn("l_r", wide("l") * wide("r")).withColumn("score", score)
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best"))
    )
    # If a longer phrase is as frequent, so are all phrases between, so one word more is enough to ask.
    within = (
        candidates.where("k > 2")
        .select("lang", "a", F.explode(F.array(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.lit(2), F.col("k") - 1))).alias("inner"))
        .groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    )
    return (
        cut.join(within, ["lang", "phrase"], "left").where("longer is null or longer < best.a")
        .select("lang", "phrase", *(F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")))
    )


def mined(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts hold no words; a missing language counts as `und`; repeated rows count each;
    ties go by occurrences and then by phrase; an empty table gives no rows; texts of any length pass
    in slabs, and other columns are not read.
    """
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        collocations(docs, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
