"""Repeated byte strings by sorting sampled suffixes in range partitions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from titrant.llm import kernels
from titrant.llm.shared import back_to_id, by_batch, keyed_texts, removed, row_id, written

#: Bytes of a string that counts as repeated, and of the head by which suffixes are sampled: of the
#: 26 heads in a 50-byte string the one with the least hash is its anchor, so equal strings have
#: equal anchors, and a suffix that starts at an anchor stands for all strings around it.
WINDOW, HEAD = 50, 25
SPREAD = WINDOW - HEAD
#: Bytes of text in a slab, of head prints in a bucket, and suffixes in a bucket.
SLAB_BYTES, PRINT_BYTES, SUFFIXES = 2 << 20, 4 << 20, 100_000
#: Bytes of text that are hashed at once, so that their arrays stay in the processor's cache.
HASHED_BYTES = 1 << 18
#: A head with more suffixes than this is dealt over many tasks; so is one with more than a hundred
#: thousandth of all, so that a list of such heads stays short.
HOT_SUFFIXES, HOT_HEADS = 50_000, 100_000
#: Suffixes whose leading bytes are sampled for splitters, at most.
SAMPLE = 20_000
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Hash of each head; start, text and anchor of each string that fits in its text."""
    heads = kernels.run_hashes(kernels.byte_values(0, False)[data], HEAD)
    starts, owner = kernels.fitting(offsets, WINDOW)
    if not len(starts):
        return heads, starts, owner, starts
    # Hash above, place below: the least hash wins, of equal ones the rightmost.
    n = len(heads)
    best = (heads & ~_LOW) | (_LOW - (np.arange(n, dtype=np.uint64) & _LOW))
    span, width = 1, SPREAD + 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    place = (_LOW - (best[starts] & _LOW)).astype(np.int64)
    return heads, starts, owner, (starts & ~np.int64(int(_LOW))) + place + np.where(place < (starts & np.int64(int(_LOW))), int(_LOW) + 1, 0)


def _slabbed(batch: pa.RecordBatch):
    """The heads of the anchors in one slab, each once, cut by the bucket of their hash."""
    buckets = batch["buckets"][0].as_py() if len(batch) else 1
    slab = batch["slab"].to_numpy()
    data, offsets = kernels.text_bytes(batch["text"])
    rows: list = []
    for cut in np.split(np.arange(len(slab)), np.flatnonzero(np.diff(slab)) + 1) if len(slab) else ():
        found = []
        # A very long text is hashed in pieces that overlap by all but one byte of a string.
        for low, high in kernels.slabs(offsets[cut[0] : cut[-1] + 2] - offsets[cut[0]], HASHED_BYTES):
            base = offsets[cut[0] + low]
            whole, inner = data[base : offsets[cut[0] + high]], offsets[cut[0] + low : cut[0] + high + 1] - base
            for piece, edges in pieces(whole, inner):
                heads, _, _, at = anchors(piece, edges)
                found.append(np.unique(heads[at[_starts_of_runs(at[:, None])]] if len(at) else heads[:0]))
        prints = np.unique(np.concatenate(found))
        of = (prints >> np.uint64(40)).astype(np.int64) * buckets >> 24
        edges = np.searchsorted(of, np.arange(buckets + 1))
        rows += [(int(slab[cut[0]]), b, prints[edges[b] : edges[b + 1]].tobytes()) for b in range(buckets) if edges[b] < edges[b + 1]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        ["slab", "bucket", "prints"],
    )


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 8 << 20):
    """Bytes and offsets as they are, or a single long text in overlapping pieces."""
    if len(data) <= most or len(offsets) > 2:
        yield data, offsets
        return
    for low in range(0, len(data) - WINDOW + 1, most):
        part = data[low : low + most + WINDOW - 1]
        yield part, np.array([0, len(part)])


def _recurring(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of head prints, those that more than one text may hold, back to their slabs.

    A print that one slab alone holds may still recur inside it, so slabs also get those of their
    prints that no other slab has; they tell them apart themselves.
    """
    parts = [np.frombuffer(x, np.uint64) for x in group["prints"]]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[counts > 1]
    return pd.DataFrame({"slab": group["slab"].to_numpy(), "known": [np.intersect1d(p, shared, assume_unique=True).tobytes() for p in parts]})


def _inside(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def suffixes_of(ids: np.ndarray, ths: np.ndarray, texts: list[bytes], known: np.ndarray) -> pd.DataFrame:
    """A row per sampled suffix of a slab that may recur: its text, its place, SPREAD bytes before it
    and WINDOW from it, and from how far back strings have it as anchor."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    runs, seen = [], []
    for low, high in kernels.slabs(offsets, HASHED_BYTES):
        inner = offsets[low : high + 1] - offsets[low]
        done = 0
        for piece, edges in pieces(data[offsets[low] : offsets[high]], inner):
            heads, starts, owner, at = anchors(piece, edges)
            if len(starts):
                fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
                last = np.concatenate((fresh[1:], [len(at)])) - 1
                runs.append((heads[at[fresh]], owner[fresh] + low, at[fresh] + offsets[low] + done, at[fresh] - starts[last], at[fresh] - starts[fresh]))
            done += len(piece) - WINDOW + 1
    if not runs:
        return pd.DataFrame({"head": [], "id": [], "th": [], "place": [], "near": [], "far": [], "around": []})
    head, owner, place, near, far = (np.concatenate([r[k] for r in runs]) for k in range(5))
    # Recurring: in another slab as well, or in a second text of this one.
    order = np.lexsort((owner, head))
    h, o = head[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    twice = h[first][np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)]
    used = np.flatnonzero(_inside(known, head) | _inside(twice, head))
    head, owner, place, near, far = head[used], owner[used], place[used], near[used], far[used]
    padded = np.concatenate((np.zeros(SPREAD, np.uint8), data, np.zeros(WINDOW, np.uint8)))
    around = padded[place[:, None] + np.arange(SPREAD + WINDOW)[None]] if len(place) else np.zeros((0, SPREAD + WINDOW), np.uint8)
    flat = around.tobytes()
    width = SPREAD + WINDOW
    return pd.DataFrame({
        "head": head.view(np.int64), "id": ids[owner], "th": ths[owner], "place": place - offsets[owner], "near": near, "far": far,
        "around": [flat[i * width : (i + 1) * width] for i in range(len(place))],
    })


def multikey_order(keys: np.ndarray, least: int = 64) -> np.ndarray:
    """Order of rows of byte tokens, by multikey quicksort: rows split around a pivot in one token
    into less, equal and greater, and only equal ones move on to the next token. Small and settled
    parts are sorted directly on the tokens that are left."""
    order, width = np.arange(len(keys)), keys.shape[1]
    stack = [(0, len(keys), 0)]
    while stack:
        low, high, k = stack.pop()
        if high - low < 2 or k == width:
            continue
        rows = order[low:high]
        if high - low <= least:
            order[low:high] = rows[np.lexsort(keys[rows, k:].T[::-1])]
            continue
        token = keys[rows, k]
        pivot = np.partition(token, len(token) // 2)[len(token) // 2]
        less, same = token < pivot, token == pivot
        a, b = int(less.sum()), int(same.sum())
        order[low:high] = np.concatenate((rows[less], rows[same], rows[~less & ~same]))
        stack += [(low, low + a, k), (low + a, low + a + b, k + 1), (low + a + b, high, k)]
    return order


def _tokens(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian tokens of 8 bytes, which sort as the bytes do."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def _starts_of_runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))


def covered(around: np.ndarray, ids: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of every 50-byte string, given by how far it starts before its anchor, that
    also stands in a text with a smaller id among the rows.

    One sort, from the anchor on and then by the bytes before it, brings equal rows together. Of
    equal rows, those beyond the least id lose all their strings, and one stands for the others.
    Only where such rows differ behind one head, as they do at the ends of a repeated passage, the
    strings that they have at each distance are sorted and compared with their neighbours.
    """
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead, before = around[:, SPREAD:], around[:, :SPREAD]
    keys = np.concatenate((_tokens(ahead), _tokens(before), near[:, None].astype(np.uint64), far[:, None].astype(np.uint64)), axis=1)
    order = multikey_order(keys)
    keys, own = keys[order], ids[order]
    first = _starts_of_runs(keys)
    of_class = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
    least = np.minimum.reduceat(own, first)
    later = own > least[of_class]
    spans = (far - near + 1)[order[later]]
    rows = [np.repeat(order[later], spans)]
    backs = [np.repeat(near[order[later]] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
    # Classes of one head: tokens before the last one of the head agree, and its last byte.
    heads = _tokens(ahead[:, :HEAD])[order][first]
    head_of = np.cumsum(np.concatenate(([0], (heads[1:] != heads[:-1]).any(axis=1).astype(np.int64)))) if len(heads) else np.zeros(0, np.int64)
    mixed = np.flatnonzero(np.bincount(head_of)[head_of] > 1)
    members = np.split(order, first[1:])
    leader = order[first]
    for back in range(SPREAD + 1):
        some = mixed[(near[leader[mixed]] <= back) & (back <= far[leader[mixed]])]
        if len(some) < 2:
            continue
        strings = _tokens(around[leader[some], SPREAD - back : SPREAD - back + WINDOW])
        placed = multikey_order(strings)
        runs, low = _starts_of_runs(strings[placed]), least[some][placed]
        lowest = np.repeat(np.minimum.reduceat(low, runs), np.diff(np.append(runs, len(low))))
        for c in some[placed[lowest < low]]:
            hit = members[c][ids[members[c]] == least[c]]
            rows.append(hit)
            backs.append(np.full(len(hit), back))
    return np.concatenate(rows), np.concatenate(backs)


def _rows_of(group: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The `around` column as rows of bytes; all of its values have one width."""
    parts = group["around"].chunks if isinstance(group, pa.Table) else [group["around"]]
    width, flat = SPREAD + WINDOW, []
    for part in parts:
        if len(part):
            kind = np.int64 if pa.types.is_large_binary(part.type) else np.int32
            _, places, data = part.buffers()
            low = int(np.frombuffer(places, kind, 1, part.offset * np.dtype(kind).itemsize)[0])
            flat.append(np.frombuffer(data, np.uint8, len(part) * width, low))
    return np.concatenate([np.zeros(0, np.uint8), *flat]).reshape(-1, width)


def _bucket(group: pa.Table) -> pa.Table:
    """The starts of covered strings in one range of suffixes, a list per text."""
    ids, ths, places, near, far = (group[c].to_numpy() for c in ("id", "th", "place", "near", "far"))
    hit, back = covered(_rows_of(group), ids, near, far)
    order = np.lexsort((ths[hit], ids[hit]))
    id_, th, start = ids[hit][order], ths[hit][order], (places[hit] - back)[order]
    first = _starts_of_runs(np.stack((id_, th), axis=1)) if len(id_) else np.zeros(0, np.int64)
    ends = np.append(first, len(id_)).astype(np.int32)
    return pa.table({"id": id_[first], "th": th[first], "start": pa.ListArray.from_arrays(pa.array(ends), pa.array(start))})


def _strings(batch: pa.RecordBatch):
    """Hot suffixes: a row per 50-byte string."""
    around = _rows_of(batch)
    place, near, far = (batch[c].to_numpy() for c in ("place", "near", "far"))
    for back in range(SPREAD + 1):
        some = np.flatnonzero((near <= back) & (back <= far))
        strings = np.ascontiguousarray(around[some, SPREAD - back : SPREAD - back + WINDOW])
        ends = np.arange(len(some) + 1, dtype=np.int32) * np.int32(WINDOW)
        which = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(strings)]),
                batch["id"].take(which), batch["th"].take(which), pa.array(place[some] - back),
            ],
            ["string", "id", "th", "start"],
        )


def _cut(batch: pa.RecordBatch):
    """What is left of each text without the bytes of its covered strings."""
    removed_, spans, shas, kept = [], [], [], []
    data, offsets = kernels.text_bytes(batch["text"])
    # Lists of lists of starts, as one array and where those of each text begin.
    inner = batch["starts"].flatten()
    flat = inner.flatten().to_numpy()
    lists = np.concatenate(([0], np.cumsum(pc.list_value_length(batch["starts"]).to_numpy())))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(inner).to_numpy())))[lists]
    for i in range(len(batch)):
        raw = data[offsets[i] : offsets[i + 1]]
        edge, starts = np.zeros(len(raw) + 1, np.int8), flat[ends[i] : ends[i + 1]]
        # Sums up to WINDOW at a place, since each start counts once.
        edge[starts] = 1
        after = np.zeros(len(raw) + 1, np.int8)
        after[starts + WINDOW] = 1
        gone = np.cumsum(edge - after, dtype=np.int8)[:-1] > 0
        rest = raw[~gone].tobytes()
        removed_.append(int(gone.sum()))
        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        shas.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    yield pa.RecordBatch.from_arrays(
        [batch["id"], batch["th"], pa.array(removed_, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())],
        ["id", "th", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(id, th, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; `kept` (binary) is
    what is left, and null where nothing was removed.

    1. Equal texts are settled at once: all but the smallest id lose every byte, if they have 50.
    2. Suffixes are sampled at anchors, about one byte in 13. Prints of their heads travel in packed
       blocks, one block per slab of text and bucket, and tell which heads may recur.
    3. The suffixes that may recur, with what stands around them, are range-partitioned by their
       leading bytes at splitters sampled from them. Each bucket is sorted by multikey quicksort, so
       equal suffixes become neighbours and the least id of each run decides; where suffixes differ
       behind one head, so are their strings at each distance from the anchor. Splitters are whole
       heads, and equal strings have equal heads, so no run crosses a border, except where a head
       has too many suffixes for one task: the strings around such a head are compared across all
       tasks by one aggregation and a join.

    Null and empty texts have no bytes; texts under 50 bytes lose nothing. Rows that repeat an id
    do not remove each other's bytes; a missing id sorts last. Other columns are not read.
    """
    texts = keyed_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    facts = written(texts.select("id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "suffix-facts")
    firsts = facts.groupBy("digest", "n_bytes").agg(F.min("id").alias("first"))
    ranked = facts.join(firsts, ["digest", "n_bytes"])
    single = ranked.where(f"id = first and n_bytes >= {WINDOW}").select("id", "th", "n_bytes").distinct()
    size = single.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    slabs = max(1, -(-size[0] // SLAB_BYTES))
    buckets = max(1, -(-size[0] * 8 // 13 // PRINT_BYTES))
    slabbed = (
        texts.join(single.drop("n_bytes"), ["id", "th"], "left_semi")
        .withColumn("slab", F.pmod(F.xxhash64("id", "th"), F.lit(slabs)))
        .repartition("slab").sortWithinPartitions("slab")
    )
    likely = written(slabbed, "suffix-texts")
    prints = by_batch(likely.select("slab", F.lit(buckets).alias("buckets"), "text"), _slabbed, "slab bigint, bucket bigint, prints binary")
    known = written(prints.groupBy("bucket").applyInPandas(_recurring, "slab bigint, known binary"), "suffix-known")

    def sampled(key, group: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["id", "th"])
        known_ = np.unique(np.frombuffer(b"".join(heads["known"]), np.uint64))
        return suffixes_of(group["id"].to_numpy(), group["th"].to_numpy(), [t.encode() for t in group["text"]], known_)

    schema = "head bigint, id bigint, th bigint, place bigint, near bigint, far bigint, around binary"
    suffixes = written(likely.groupBy("slab").cogroup(known.groupBy("slab")).applyInPandas(sampled, schema), "suffix-found")
    removed(known)
    most = F.greatest(F.lit(HOT_SUFFIXES).cast("bigint"), F.lit(suffixes.count() // HOT_HEADS))
    hot = written(suffixes.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("head", F.lit(True).alias("hot")), "suffix-heads")
    found = suffixes.join(F.broadcast(hot), "head", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lead = F.substring("around", SPREAD + 1, HEAD)
    total = found.where("not hot").count()
    n = max(1, -(-total // SUFFIXES))
    # Splitters: the leading bytes of a bounded sample, chosen by hash, at even ranks.
    share = min(1.0, SAMPLE / max(1, total))
    picked = (
        found.where("not hot").where(F.pmod(F.xxhash64("id", "th", "place"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        .select(lead.alias("lead")).orderBy("lead").limit(2 * SAMPLE).collect()
    )
    splits = sorted({bytes(picked[len(picked) * k // n]["lead"]) for k in range(1, n)}) if picked else []
    shared = docs.sparkSession.sparkContext.broadcast(splits)

    def numbered(leads: pd.Series) -> pd.Series:
        import bisect

        return pd.Series([bisect.bisect_right(shared.value, bytes(x)) for x in leads], dtype="int64")

    numbered.__annotations__ = {"leads": pd.Series, "return": pd.Series}
    from pyspark.sql.types import LongType

    ranged = found.where("not hot").withColumn("range", F.pandas_udf(numbered, LongType())(lead))
    ranged = ranged.select("range", "id", "th", "place", "near", "far", "around")
    plain = ranged.groupBy("range").applyInArrow(_bucket, "id bigint, th bigint, start array<bigint>")
    strings = written(by_batch(found.where("hot"), _strings, "string binary, id bigint, th bigint, start bigint"), "suffix-hot")
    least = strings.groupBy("string").agg(F.min("id").alias("least"))
    spread = strings.join(least, "string").where("least < id").groupBy("id", "th").agg(F.collect_set("start").alias("start"))
    starts = written(plain.unionByName(spread).groupBy("id", "th").agg(F.collect_list("start").alias("starts")), "suffix-starts")
    removed(suffixes, hot, strings)
    cut = written(
        by_batch(
            likely.select("id", "th", "text").join(starts, ["id", "th"]), _cut,
            "id bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
        ).dropDuplicates(["id", "th"]),
        "suffix-cut",
    )
    removed(likely)
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= WINDOW)
    return ranked.withColumn("copy", copy).join(cut, ["id", "th"], "left").select(
        "id", "th", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select(back_to_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
