"""Repeated passages by confirmed phrases and Aho-Corasick automata."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from titrant.llm import kernels
from titrant.llm.shared import back_to_id, by_batch, keyed_texts, removed, row_id, written

#: Words of a window, and of the phrase by which windows are first told apart: of the phrases in a
#: window the one with the least hash is its anchor, so equal windows have equal anchors.
WINDOW, PHRASE = 50, 25
#: Texts that one automaton serves.
SHARD_TEXTS = 256


def _words(batch: pa.RecordBatch):
    """Per slab: its range of texts, the word hashes, where texts begin, and the bytes of words."""
    data, offsets = kernels.text_bytes(batch["text"])
    for low, high in kernels.slabs(offsets):
        cut = offsets[low : high + 1]
        part, cut = data[cut[0] : cut[-1]], cut - cut[0]
        starts, ends, first = kernels.word_spans(part, cut)
        yield low, high, kernels.span_hashes(part, starts, ends), first, part, cut


def _anchors(words: np.ndarray, first: np.ndarray):
    """Hashes of all phrases; start, text and anchor of every window."""
    runs = kernels.run_hashes(words, PHRASE)
    starts, owner = kernels.fitting(first, WINDOW)
    return runs, starts, owner, kernels.sliding_minimum(runs, WINDOW - PHRASE + 1)[starts]


def _facts(batch: pa.RecordBatch):
    """Number of words, digest of the words, and the anchors of each text."""
    counts, digests, prints, places, sizes = [], [], [], [], []
    for low, high, words, first, part, cut in _words(batch):
        runs, starts, owner, anchor = _anchors(words, first)
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        prints.append(runs[anchor[fresh]])
        places.append((anchor[fresh] - first[owner[fresh]]).astype(np.int32))
        sizes.append(np.bincount(owner[fresh], minlength=high - low))
        counts.append(np.diff(first))
        raw = part.tobytes()
        digests += [hashlib.sha256(b" ".join(raw[cut[i] : cut[i + 1]].split())).hexdigest() for i in range(high - low)]
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    at = pa.array(np.concatenate(([0], np.cumsum(join(sizes, np.int64)))).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            batch["id"], batch["th"], pa.array(join(counts, np.int64), pa.int64()), pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(at, pa.array(join(prints, np.uint64).view(np.int64))),
            pa.ListArray.from_arrays(at, pa.array(join(places, np.int32))),
        ],
        ["id", "th", "n_words", "digest", "prints", "places"],
    )


def _windows(batch: pa.RecordBatch):
    """A row per window whose anchor is among the confirmed phrases of its text."""
    known = batch["at"]
    begins = known.offsets.to_numpy()
    at = known.values.to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, np.int32)
    for low, high, words, first, _, _ in _words(batch):
        _, starts, owner, anchor = _anchors(words, first)
        own = np.concatenate([first[i - low] + at[begins[i] : begins[i + 1]] for i in range(low, high)])
        mark = np.zeros(len(words) + 1, bool)
        mark[own] = True
        used = mark[anchor]
        starts, owner = starts[used], owner[used]
        text = pa.array(owner + low)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kernels.run_hashes(words, WINDOW, 0)[starts].view(np.int64)), pa.array(kernels.run_hashes(words, WINDOW, 1)[starts].view(np.int64)),
                batch["id"].take(text), batch["th"].take(text), pa.array((starts - first[owner]).astype(np.int32)),
            ],
            ["h1", "h2", "id", "th", "place"],
        )


def _passages(batch: pa.RecordBatch):
    """The runs of recurring windows that a text is the first to hold, as text."""
    owners, texts = [], []
    for i, text, own in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["own"].to_pylist(), strict=True):
        words, places = text.encode().split(), np.unique(np.array(own, np.int64))
        for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
            owners.append(i)
            texts.append(b" ".join(words[run[0] : run[-1] + WINDOW]).decode())
    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(texts, pa.string())], ["owner", "passage"])


def _window_keys(words: list[int]) -> list[np.ndarray]:
    x = kernels.mix(np.array(words, np.uint64) + np.uint64(3))
    return [kernels.run_hashes(x, WINDOW, salt) for salt in (0, 1)]


def _located(texts: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """One shard: an automaton over its passages, and all of its texts streamed through it.

    The automaton's patterns are the passages cut into tiles of 25 words, one of which lies wholly
    within any 50-word window. Where a tile occurs in a text, the windows around it are looked up
    among the windows of the passages; those whose first holder is a smaller id are covered.
    """
    number: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: list[list[np.ndarray]] = [[], [], []]
    for owner, passage in zip(passages["owner"], passages["passage"], strict=True):
        ids = [number.setdefault(w, len(number) + 1) for w in passage.encode().split()]
        for k in range(0, len(ids) - PHRASE + 1, PHRASE):
            machine.add_word(tuple(ids[k : k + PHRASE]), 1)
        h1, h2 = _window_keys(ids)
        for k, x in enumerate((h1, h2, np.full(len(h1), owner, np.int64))):
            keys[k].append(x)
    machine.make_automaton()
    one, two, owner = (np.concatenate(x) for x in keys)
    order = np.lexsort((owner, two, one))
    one, two, owner = one[order], two[order], owner[order]
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    one, two, owner = one[fresh], two[fresh], owner[fresh]
    out = []
    for i, th, text in zip(texts["id"], texts["th"], texts["text"], strict=True):
        words = text.encode().split()
        ids = [number.get(w, 0) for w in words]
        ends = np.fromiter((e for e, _ in machine.iter(tuple(ids))), np.int64)
        n = len(ids) - WINDOW + 1
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(ends - WINDOW + 1, 0, n), 1)
        np.add.at(near, np.clip(ends - PHRASE + 2, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
        h1, h2 = (h[starts] for h in _window_keys(ids))
        # Equal first halves are rare; each step moves on those whose second half differs.
        k, found = np.searchsorted(one, h1), np.zeros(len(starts), bool)
        live = np.arange(len(starts))
        while len(live := live[(k[live] < len(one))]) and len(live := live[one[k[live]] == h1[live]]):
            hit = two[k[live]] == h2[live]
            found[live[hit]] = owner[k[live[hit]]] < i
            live = live[~hit]
            k[live] += 1
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, starts[found], 1)
        np.add.at(gone, starts[found] + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, th, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return pd.DataFrame(out, columns=["id", "th", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(id, th, n_words, n_removed, kept_sha256, kept) for every row of `docs`; `kept` is the text
    left, words joined by one space, and null where nothing was removed from the text.

    1. Texts with one and the same word sequence are settled at once: all but the smallest id lose
       every word, if they have 50. One of them takes part in what follows.
    2. Confirmed phrases: anchors of 25 words that texts with different ids share. Every 50-word
       window has one, so a window without a confirmed anchor cannot recur. About one word in 13 is
       an anchor, and only windows around confirmed ones are hashed, counted and given the smallest
       id that holds them.
    3. Runs of windows that a text is the first to hold are its passages. Texts are dealt to shards
       by hash, and a passage goes to the shards whose texts share a window with its holder; the
       shard's automaton then locates every occurrence. A shard's automaton grows with its own
       texts, never with the corpus, and every text that can hold an occurrence is streamed once.

    Null, empty and short texts lose nothing. Equal ids are not smaller than each other, so rows
    that repeat an id keep their words; a missing id sorts last. Other columns are not read.
    """
    texts = keyed_texts(docs)
    facts = written(
        by_batch(texts, _facts, "id bigint, th bigint, n_words bigint, digest string, prints array<bigint>, places array<int>"), "phrase-facts"
    )
    firsts = facts.groupBy("digest", "n_words").agg(F.min("id").alias("first"))
    ranked = facts.join(firsts, ["digest", "n_words"])
    single = written(ranked.where(f"id = first and n_words >= {WINDOW}").select("id", "th", "prints", "places"), "phrase-anchors")
    anchors = single.select("id", "th", F.explode(F.arrays_zip("prints", "places")).alias("a")).select("id", "th", F.col("a.prints").alias("print"), F.col("a.places").alias("place"))
    confirmed = anchors.groupBy("print").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("print")
    at = anchors.join(confirmed, "print").groupBy("id", "th").agg(F.collect_set("place").alias("at"))
    likely = written(texts.join(at, ["id", "th"]), "phrase-texts")
    removed(single)
    windows = written(by_batch(likely, _windows, "h1 bigint, h2 bigint, id bigint, th bigint, place int"), "phrase-windows")
    holders = windows.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("high")).where("owner < high").drop("high")
    shared = written(
        windows.join(holders, ["h1", "h2"]).groupBy("id", "th").agg(
            F.collect_set(F.when(F.col("id") > F.col("owner"), F.col("owner"))).alias("owners"),
            F.collect_set(F.when(F.col("id") == F.col("owner"), F.col("place"))).alias("own"),
        ),
        "phrase-shared",
    )
    removed(windows)
    passages = written(
        by_batch(
            likely.drop("at").join(shared.where(F.size("own") > 0).select("id", "th", "own"), ["id", "th"]),
            _passages, "owner bigint, passage string",
        ).distinct(),
        "phrase-passages",
    )
    hit = shared.where(F.size("owners") > 0)
    shards = max(1, -(-hit.count() // SHARD_TEXTS))
    shard = F.pmod(F.xxhash64("id", "th"), F.lit(shards)).alias("shard")
    needs = hit.select(shard, F.explode("owners").alias("owner")).distinct()
    located = written(
        likely.select("id", "th", "text").join(hit.select("id", "th"), ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        .select(shard, "id", "th", "text").groupBy("shard")
        .cogroup(needs.join(passages, "owner").select("shard", "owner", "passage").groupBy("shard"))
        .applyInPandas(_located, "id bigint, th bigint, n_removed bigint, kept_sha256 string, kept string"),
        "phrase-located",
    )
    removed(likely)
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return ranked.select("id", "th", "n_words", "digest", copy.alias("copy")).join(located, ["id", "th"], "left").select(
        "id", "th", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select(back_to_id("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with repeated passages cut from `text`, all columns kept."""
    found = without_repeats(docs).where("n_removed > 0").select("id", "th", "kept").dropDuplicates(["id", "th"])
    whole = docs.select(F.struct("*").alias("row"), row_id().alias("id"), F.xxhash64("text").alias("th")).join(found, ["id", "th"], "left")
    return whole.select(*[F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
