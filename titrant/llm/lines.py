"""Fuzzy line deduplication across documents by MinHash."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from titrant.llm import kernels
from titrant.llm.components import components
from titrant.llm.shared import back_to_id, by_batch, hash_filter, keyed_texts, passing, removed, row_id, written

#: Characters of a shingle, and the fewest characters of a line that is compared by shingles. Shorter
#: lines are removed where they repeat an earlier one exactly, in normal form.
SHINGLE = 5
MIN_CHARS = 20
#: Lines count as similar from here on. With 16 bands of 4 rows a pair at this similarity meets in
#: some band in 99.8 of 100 cases, one at 0.8 in 99.98.
SIMILARITY = 0.75
BANDS, ROWS = 16, 4
#: Bands that are dealt out at once: the shuffled rows of one round are gone before the next.
ROUND = 4
#: Lines of one side of a comparison of sketches inside one task; of texts, half as many. Members of
#: a larger group move once for each chunk of the other side.
CHUNK = 1024
#: Members of a bucket, the first by class, that each of its members is compared with by sketch; the
#: partners of a member that become pairs at once; and pairs that a task judges at a time.
MEETING, TOLD, PAIRS = 256, 3, 1 << 18
_BINS = BANDS * ROWS
#: From this many shingles on a line is long: one hash function fills its bins, and its sketch holds 4
#: bits of each of its 64 least hashes. Below, each bin has a hash function, and the sketch is the
#: parity of its shingles in each of 256 places. Lines on both sides of this limit can be similar, so
#: the long ones of them have the band keys of a short line besides their own.
LONG = 128
#: Bins of 64 that long lines must agree in, by 4 bits each, to be compared exactly. At a similarity
#: of 0.75 that many more than 49 are expected; 32 is five standard deviations below.
AGREEING = 32
#: Characters of lines that are hashed at once, which bounds the memory of a task.
PART_CHARS = 500_000
#: Characters of lines whose shingles a task keeps for the next comparisons.
KEPT_CHARS = 200_000
#: Bytes of the Arrow batches that carry whole texts or lines into a task.
BATCH_BYTES = 4 << 20
_EMPTY = np.uint64(2**64 - 1)
#: One hash function of short lines per bin.
_FLIP = kernels.mix(np.arange(1000, 1000 + _BINS, dtype=np.uint64))
_TIMES = kernels.mix(np.arange(2000, 2000 + _BINS, dtype=np.uint64)) | np.uint64(1)
_SKETCH = ["s1", "s2", "s3", "s4"]


def normal(line: str) -> str:
    """Lower case, blanks as single spaces, none at the ends."""
    return " ".join(line.lower().split())


def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)


def _shingled(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every shingle, the line that it belongs to, and the number of shingles per line."""
    points, first = _characters(lines)
    runs = kernels.run_hashes(kernels.mix(points + np.uint64(77)), SHINGLE)
    places, owner = kernels.fitting(first, SHINGLE)
    return runs[places], owner, np.maximum(np.diff(first) - SHINGLE + 1, 0)


def _binned(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For long lines: one hash per shingle, its least value per bin; an empty bin takes the next
    full one to its right. Work grows with the characters and not with the number of bins."""
    least = np.full(n * _BINS, _EMPTY, np.uint64)
    np.minimum.at(least, owner * _BINS + (values >> np.uint64(40)).astype(np.int64) * _BINS // (1 << 24), values & np.uint64(2**40 - 1))
    least = least.reshape(n, _BINS)
    step = 1
    while step < _BINS:
        nearest = np.roll(least, -step, axis=1)
        fill = (least == _EMPTY) & (nearest != _EMPTY)
        least[fill] = nearest[fill] + np.uint64(step << 41)
        step *= 2
    return least


def _hashed(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For wanted lines: the least value of each of as many hash functions as there are bins."""
    out = np.zeros((len(counts), _BINS), np.uint64)
    rest = values[wanted[owner]]
    some = np.flatnonzero(wanted & (counts > 0))
    if len(some):
        starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
        for k in range(_BINS):
            out[some, k] = np.minimum.reduceat((rest ^ _FLIP[k]) * _TIMES[k], starts)
    return out


def _told(least: np.ndarray) -> np.ndarray:
    return kernels.mix(least + np.arange(_BINS, dtype=np.uint64))


def signatures(values: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least hashes of each line's shingles. Short lines would leave most bins empty, and bins
    that borrow from one neighbour agree together, so they get as many hash functions instead."""
    long = counts >= LONG
    number = np.cumsum(long) - 1
    some = long[owner]
    out = _hashed(values, owner, counts, ~long)
    out[long] = _binned(values[some], number[owner[some]], int(long.sum()))
    return _told(out)


def _within_reach(values: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which long lines can be similar to a short one: those that may hold no more different shingles
    than a short line's over the similarity. Hashed places hold no more than there are different
    shingles, so none of them is missed."""
    out = counts >= LONG
    number = np.cumsum(out) - 1
    some = out[owner]
    held = np.zeros((int(out.sum()), 1024), bool)
    held[number[owner[some]], (values[some] >> np.uint64(20)).astype(np.int64) & 1023] = True
    out[out] = held.sum(axis=1) <= (LONG - 1) / SIMILARITY
    return out


def _keys(least: np.ndarray) -> np.ndarray:
    """Band keys. The rows of a band lie apart, so that no two of them borrow from one bin."""
    odd = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    grouped = least.reshape(len(least), ROWS, BANDS)
    return kernels.mix((grouped * odd[:ROWS, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _all_keys(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether a line has them): two for each band, one from either kind of signature. Long
    lines that can be similar to a short one have both, so lines meet wherever the limit between
    short and long lies; others have the key of their own kind."""
    long, both = counts >= LONG, _within_reach(values, owner, counts)
    keys, own = np.zeros((len(counts), BANDS, 2), np.uint64), _keys(least)
    keys[~long, :, 0], keys[long, :, 1] = own[~long], own[long]
    if both.any():
        keys[both, :, 0] = _keys(_told(_hashed(values, owner, counts, both)[both]))
    held = np.repeat(np.stack([~long | both, long], axis=1)[:, None], BANDS, axis=1)
    return keys.reshape(-1, 2 * BANDS), held.reshape(-1, 2 * BANDS)


def band_keys(lines: list[str]) -> np.ma.MaskedArray:
    """The band keys of lines of at least SHINGLE characters, one row each; keys that a line lacks are masked."""
    shingled = _shingled(lines)
    keys, held = _all_keys(*shingled, signatures(*shingled))
    return np.ma.array(keys, mask=~held)


def _sketches(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of shingles of each line (of different ones where it is short), and its sketch of
    4 x 64 bits."""
    n, short = len(counts), counts[owner] < LONG
    pairs = np.unique((owner[short].astype(np.uint64) << np.uint64(50)) | (values[short] >> np.uint64(14)))
    of = (pairs >> np.uint64(50)).astype(np.int64)
    sizes = np.where(counts < LONG, np.bincount(of, minlength=n), counts)
    parity = np.bincount(of * 256 + (pairs & np.uint64(255)).astype(np.int64), minlength=256 * n).reshape(n, 256) & 1
    sketch = np.packbits(parity.astype(np.uint8), axis=1).view(np.uint64)
    nibbles = (least >> np.uint64(13)) & np.uint64(15)
    packed = (nibbles.reshape(n, 4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
    return sizes, np.where((counts < LONG)[:, None], sketch, packed)


def _can_be_alike(x: np.ndarray, y: np.ndarray, apart_by, similarity: float, share: float) -> np.ndarray:
    """Whether lines of x and y shingles, whose sketches differ by these words, can be that similar.

    Of two short lines, the smaller set has at least that share of the larger, and they differ in no
    fewer shingles than places of odd difference: neither bound loses anything. Long lines are
    estimated from their least hashes; a short and a long one have no sketch in common and pass.
    """
    apart = odd = np.int16(0)
    for v in apart_by:
        odd = odd + np.bitwise_count(v)
        v = v | (v >> np.uint64(2))
        apart = apart + np.bitwise_count((v | (v >> np.uint64(1))) & np.uint64(0x1111111111111111))
    least, most = np.minimum(x, y), np.maximum(x, y)
    short = (least >= similarity * most) & (odd <= share * (x + y) + 1e-9)
    return np.where(most < LONG, short, (least < LONG) | (apart <= _BINS - AGREEING))


def _judged(texts: pa.Array, min_chars: int):
    """(text number, line number, normal form, whether shingles compare it) of every line that is
    not blank."""
    for i, text in enumerate(texts):
        for k, line in enumerate((text.as_py() or "").split("\n")):
            if short := normal(line):
                yield i, k, short, len(short) >= min_chars


def _class(line: str) -> tuple[int, int]:
    raw = hashlib.blake2b(line.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _parts(found, most_lines: int = 8192, most_chars: int = PART_CHARS):
    """Lists of lines of bounded number and length; a single longer line is a list of its own."""
    part, chars = [], 0
    for x in found:
        if part and (len(part) == most_lines or chars + len(x[2]) > most_chars):
            yield part
            part, chars = [], 0
        part.append(x)
        chars += len(x[2])
    if part:
        yield part


def _signed(min_chars: int):
    def sign(batch: pa.RecordBatch):
        """A row per line: where it stands, its class, its sketch and its band keys."""
        for part in _parts(_judged(batch["text"], min_chars)):
            of = pa.array([x[0] for x in part], pa.int64())
            names = [_class(x[2]) for x in part]
            wide = np.array([x[3] for x in part])
            values, owner, counts = _shingled([x[2] for x in part if x[3]])
            least = signatures(values, owner, counts)
            sizes, sketch, (keys, held) = np.zeros(len(part), np.int64), np.zeros((len(part), 4), np.uint64), _all_keys(values, owner, counts, least)
            sizes[wide], sketch[wide] = _sketches(values, owner, counts, least)
            of_line = np.zeros(len(part), np.int64)
            of_line[wide] = held.sum(axis=1)
            ends = np.concatenate(([0], np.cumsum(of_line))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(of), batch["th"].take(of), pa.array([x[1] for x in part], pa.int32()),
                    pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array(sizes.astype(np.int32)),
                    *(pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(4)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[held].view(np.int64))),
                ],
                ["id", "th", "line", "c", "c2", "n", *_SKETCH, "keys"],
            )

    return sign


def _worded(min_chars: int, wanted: np.ndarray):
    def word(batch: pa.RecordBatch):
        seen: set[int] = set()
        for part in _parts(x for x in _judged(batch["text"], min_chars) if x[3]):
            found = {_class(x[2])[0]: x[2] for x in part}
            names = np.array(list(found), np.int64)
            held = {c: found[c] for c in names[passing(wanted, names)].tolist() if c not in seen}
            seen.update(held)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.string())], ["c", "words"])

    return word


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the exact Jaccard similarity of two lines' shingles is at least `least`."""
    known: dict[str, set[str]] = {}
    held = 0

    def shingles(x: str) -> set[str]:
        nonlocal held
        if (found := known.get(x)) is None:
            found = {x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)}
            if held + len(x) > KEPT_CHARS:
                known.clear()
                held = 0
            known[x] = found
            held += len(x)
        return found

    def one(x: str, y: str, t: float) -> bool:
        p, q = shingles(x), shingles(y)
        both = len(p & q)
        return both >= t * (len(p) + len(q) - both)

    return pd.Series([one(x, y, t) for x, y, t in zip(a, b, least, strict=True)], dtype=bool)


def _crossing(similarity: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of components in one pair of chunks, named by these; no more than join them."""
        links = []
        for _, group in rows.groupby("a"):
            left, right = group[~group["right"]].reset_index(), group[group["right"]].reset_index()
            if not len(left) or not len(right):
                continue
            n = len(left)
            values, owner, _ = _shingled([*left["words"], *right["words"]])
            sizes, both = kernels.overlaps(values, owner, n, len(right))
            near = both >= similarity * (sizes[:n, None] + sizes[None, n:] - both)
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            for i, j in zip(*np.nonzero(near & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None])), strict=True):
                p, q = left["component"][i], right["component"][j]
                if top(p) != top(q):
                    up[top(p)] = top(q)
                    links.append((p, q))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _earlier(start: np.ndarray, place: np.ndarray):
    """Pairs (i, j) of rows in blocks: each wanted place i with the first MEETING rows from its bucket's
    start on that lie before it, ordered by i, then j."""
    counts = np.minimum(place - start, MEETING)
    ends = np.cumsum(counts)
    low = 0
    while low < len(place):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = counts[low:high]
        yield np.repeat(place[low:high], n), np.arange(n.sum()) + np.repeat(start[low:high] - (ends[low:high] - n - before), n)
        low = high


def _bucketed(similarity: float):
    share = (1 - similarity) / (1 + similarity)

    def judge(rows: dict[str, np.ndarray], done: int, upto: int) -> pa.RecordBatch:
        """Of whole buckets in rows[:upto], of which the first `done` rows were judged before."""
        key, c, n = (rows[x][:upto] for x in ("key", "c", "n"))
        sketch = [rows[s] for s in _SKETCH]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, upto))
        start = np.repeat(first, sizes)
        still = np.repeat(sizes > MEETING, sizes)
        pairs = []
        for i, j in _earlier(start[done:], np.arange(done, upto)):
            found = _can_be_alike(n[i], n[j], [s[i] ^ s[j] for s in sketch], similarity, share)
            i, j = i[found], j[found]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            told = rank < TOLD
            pairs.append((c[j[told]], c[i[told]]))
            still[i[~told]] = still[j[~told]] = True
        members = np.flatnonzero(still)
        _, head, of = np.unique(start[members], return_index=True, return_inverse=True)
        head = np.where(sizes[np.searchsorted(first, start[members])] > MEETING, start[members], members[head][of])
        members, head = members[members >= done], head[members >= done]
        a, b = (np.concatenate([x[k] for x in pairs] + [y]) for k, y in ((0, c[head]), (1, c[members])))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(a) - len(members))], ["a", "b", "pair"])

    def run(batches):
        rows, done = None, 0
        for batch in batches:
            new = {x: batch[x].to_numpy() for x in ("key", "c", "n")} | {s: batch[s].to_numpy().view(np.uint64) for s in _SKETCH}
            rows = new if rows is None else {x: np.concatenate((rows[x], v)) for x, v in new.items()}
            if not (size := len(rows["key"])):
                continue
            # The last bucket may go on: it waits, or leaves its first members for those to come.
            last = int(np.searchsorted(rows["key"], rows["key"][-1]))
            large = size - last > MEETING
            if (upto := size if large else last) > done:
                yield judge(rows, done, upto)
            waits = last == 0 and not large
            rows = {x: v[last : last + MEETING].copy() for x, v in rows.items()}
            done = done if waits else MEETING if large else 0
        if rows is not None and len(rows["key"]) > done:
            yield judge(rows, done, len(rows["key"]))

    return run


def _met(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, pair) of the buckets of a few bands: pairs of classes to be compared exactly, and, where
    `pair` is false, members b of a group a in which more pairs may be similar than these.

    Rows move once, by band key, and meet in order of key and class. Each is judged by sketch against
    the first MEETING members of its bucket; its first TOLD partners are pairs. Members of further
    possible pairs are a group, and so is all of a bucket of more than MEETING members.
    """
    rows = classes.select(F.explode("keys").alias("key"), "c", "n", *_SKETCH).repartition("key").sortWithinPartitions("key", "c")
    return rows.mapInArrow(_bucketed(similarity), "a bigint, b bigint, pair boolean")


def _chunked(rows: DataFrame, most: int) -> DataFrame:
    """Members (a, c, component, main) of groups, dealt into pairs of chunks of about `most`: left ones
    hold members outside the main component, right ones all, and each pair of chunks meets once. Small
    groups share tasks."""
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("component") != F.col("main")).alias("k")).where("m > 1 and k > 0")
    sized = rows.join(sizes, "a")
    bundles = max(1, rows.count() // most)
    small = F.col("m") <= most
    sized = sized.withColumn("g", F.when(small, F.pmod(F.xxhash64("a"), F.lit(bundles))).otherwise(F.col("a"))).withColumn("one", small)
    across = F.ceil(F.col("m") / most), F.ceil(F.col("k") / most)
    sides = [
        part.withColumn(own, F.pmod(F.xxhash64("c"), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
        .select("one", "g", "i", "j", F.lit(right).alias("right"), "a", "c", "component")
        for part, own, n, other, others, right in (
            (sized.where("component <> main"), "i", across[1], "j", across[0], False), (sized, "j", across[0], "i", across[1], True),
        )
    ]
    return sides[0].unionByName(sides[1])


def _candidates(similarity: float):
    share = (1 - similarity) / (1 + similarity)

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        """The members of one pair of chunks whose sketches allow a link to another component."""
        found = []
        for a, group in rows.groupby("a"):
            right = group["right"].to_numpy()
            n, component, c = (group[x].to_numpy() for x in ("n", "component", "c"))
            held = (group[name].to_numpy().view(np.uint64) for name in _SKETCH)
            can = _can_be_alike(n[~right, None], n[None, right], (s[~right, None] ^ s[None, right] for s in held), similarity, share)
            can &= component[~right, None] != component[None, right]
            members = np.unique(np.concatenate((c[~right][can.any(axis=1)], c[right][can.any(axis=0)])))
            found.append(pd.DataFrame({"a": np.full(len(members), a), "c": members}))
        return pd.concat(found, ignore_index=True).astype("int64")

    return find


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, line) of every line that a component of similar lines holds besides its first one,
    by doc_id and place.

    Equal lines (in normal form) are one class, so only different lines are compared. Classes that
    agree in a band meet in a bucket, where every member is compared with those before it: sketches
    rule out most, shingles of 5 characters decide a few partners of each exactly, and links join
    components. Members that may have more partners, and those of very large buckets, are a group; in
    groups that still hold several components, members outside the main one are compared with the
    others in chunks, first by sketches, then the texts of those that can have a partner in another
    component; that returns no more links than join components. Where a hash of 64 bits is shared by
    different lines, which a second hash tells, those lines stay.

    Lines of fewer than `min_chars` characters go where they repeat an earlier one exactly. Blank
    lines are never touched; neither are null or empty texts. Rows that repeat a doc_id and text
    share one decision; rows that repeat a doc_id with other texts go by a hash of the text; a
    missing doc_id sorts last. Lines of any length are compared whole, and other columns are not read.
    """
    texts = keyed_texts(docs)
    sketch = ", ".join(f"{s} bigint" for s in _SKETCH)
    found = written(
        by_batch(texts, _signed(min_chars), f"id bigint, th bigint, line int, c bigint, c2 bigint, n int, {sketch}, keys array<bigint>"), "line-signatures", BATCH_BYTES
    )
    kinds = found.groupBy("c").agg(F.min("c2").alias("low"), F.max("c2").alias("high"), F.min(F.struct("n", *_SKETCH, "keys")).alias("x"))
    classes = written(kinds.select("c", (F.col("low") == F.col("high")).alias("one"), "x.*"), "line-classes")
    places = written(found.select("id", "th", "line", "c"), "line-places")
    removed(found)
    wide = classes.where("one and n > 0")
    # One key for each band, or two beside each other.
    kinds_held = (F.size("keys") / BANDS).cast("int")
    rounds = [
        written(_met(wide.withColumn("keys", F.slice("keys", kinds_held * low + 1, kinds_held * ROUND)), similarity), "line-buckets")
        for low in range(0, BANDS, ROUND)
    ]
    met = functools.reduce(DataFrame.unionByName, rounds)
    stars = written(met.where("pair").select("a", "b").distinct(), "line-pairs")
    large = met.where("not pair").select("a", F.col("b").alias("c")).distinct()
    wanted = stars.select("a").union(stars.select("b")).union(large.select("c")).toDF("c").distinct()
    held = hash_filter(wanted.withColumnRenamed("c", "h"))
    words = written(
        by_batch(texts.select("text"), _worded(min_chars, held), "c bigint, words string").join(wanted, "c", "left_semi").dropDuplicates(["c"]), "line-words", BATCH_BYTES
    )
    x = words.select(F.col("c").alias("a"), F.col("words").alias("wa"))
    y = words.select(F.col("c").alias("b"), F.col("words").alias("wb"))
    first = written(stars.join(x, "a").join(y, "b").where(_alike("wa", "wb", F.lit(similarity))).select("a", "b"), "line-links", BATCH_BYTES)
    joined = components(first).withColumnRenamed("node", "c")

    # Groups of one least class are one; one component settles it.
    groups = large.join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    main = groups.where("a = c").select("a", F.col("component").alias("main"))
    opened = groups.join(main, "a")
    unsettled = opened.groupBy("a").agg(F.count_if(F.col("component") != F.col("main")).alias("k")).where("k > 0").select("a")
    still = written(opened.join(unsettled, "a"), "line-open")
    # Sketches say which members can have a partner in another component; only their texts move.
    sketches = classes.select("c", "n", *_SKETCH)
    near = written(
        _chunked(still, CHUNK).join(sketches, "c").groupBy("one", "g", "i", "j").applyInPandas(_candidates(similarity), "a bigint, c bigint").distinct(), "line-near"
    )
    likely = written(still.join(near, ["a", "c"]), "line-open")
    second = written(
        _chunked(likely, max(1, CHUNK // 2)).join(words.select("c", "words"), "c").groupBy("one", "g", "i", "j").applyInPandas(_crossing(similarity), "a bigint, b bigint"),
        "line-links",
    )
    # The later links join whole components, so only they are searched again.
    wider = components(second).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    of_class = classes.where("one").select("c").join(joined, "c", "left").select("c", F.coalesce("component", "c").alias("component")).join(wider, "component", "left")
    where = written(places.join(of_class.select("c", F.coalesce("whole", "component").alias("component")), "c"), "line-components")
    removed(*rounds, stars, words, still, near, likely, classes, places)
    firsts = where.groupBy("component").agg(F.min(F.struct("id", "th", "line")).alias("f"))
    later = F.struct("id", "th", "line") > F.col("f")
    return where.join(firsts, "component").where(later).select("id", "th", "line")


def _without(lines: Column, gone: Column) -> Column:
    """The lines that stay, joined again. Work grows with the lines, however many of them go."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def cleaned(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, n_removed, cleaned) for every row of `docs`; `row` holds all its columns."""
    gone = repeated_lines(docs, similarity, min_chars).groupBy("id", "th").agg(F.collect_set("line").alias("gone"))
    whole = docs.select(F.struct("*").alias("row"), row_id().alias("id"), F.xxhash64("text").alias("th"))
    split = whole.join(gone, ["id", "th"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    return split.select(
        "id", "row", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_without(F.col("lines"), F.col("gone"))).alias("cleaned"),
    )


def digest(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    text = F.coalesce("cleaned", F.lit(""))
    return cleaned(docs.select("doc_id", "text"), min_chars=min_chars).select(
        back_to_id("id").alias("doc_id"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.regexp_count("row.text", F.lit("\n")) + 1).cast("bigint").alias("n_lines"),
        F.col("n_removed").cast("bigint").alias("n_removed"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
