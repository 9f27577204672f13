"""Designed sequences on backbones of fixed length, with an account of every design."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

THREADED = "threaded"


def account(sequences: DataFrame, positions: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, n_letters, n_positions, status): one row per design or backbone.

    A backbone is fixed, so letter i of a design stands at position i of it, and a design of another
    length would shift every residue by the difference: it is refused. So is one whose backbone is
    missing or has gaps or repeated positions; a backbone without a design is reported as well. Only
    one count per backbone meets its design, however long either is: positions are marked in words of
    64 bits, whose ones are the different positions. Designs that repeat a key are refused together,
    since nothing says which of them the backbone carries.
    """
    letters = sequences.groupBy(key).agg(F.max(F.length(seq)).alias("n_letters"), F.count(F.lit(1)).alias("_designs"))
    pos = F.col("pos").cast("bigint")
    words = positions.select(key, pos.alias("pos"), F.floor(pos / 64).alias("_word"), F.expr("shiftleft(1L, cast(pmod(cast(pos as bigint), 64) as int))").alias("_bit"))
    words = words.groupBy(key, "_word").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or("_bit").alias("_bits"), F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    places = words.groupBy(key).agg(
        F.sum("_n").alias("n_positions"), F.sum(F.bit_count("_bits")).alias("_distinct"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    return _reconciled(letters, places, key)


def account_of_runs(lengths: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """The same account from (key, n_letters), one row per design, and (key, low, high), runs of
    positions from low to high: each run counts the positions that none before it in order holds."""
    letters = lengths.groupBy(key).agg(F.max("n_letters").alias("n_letters"), F.count(F.lit(1)).alias("_designs"))
    earlier = W.partitionBy(key).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.max("high").over(earlier), F.col("low") - 1)
    places = runs.withColumn("_new", F.greatest(F.col("high") - seen, F.lit(0))).groupBy(key).agg(
        F.sum(F.col("high") - F.col("low") + 1).alias("n_positions"), F.sum("_new").alias("_distinct"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    return _reconciled(letters, places, key)


def _reconciled(letters: DataFrame, places: DataFrame, key: str) -> DataFrame:
    whole = (F.col("_distinct") == F.col("n_positions")) & (F.col("_low") == 0) & (F.col("_high") == F.col("n_positions") - 1)
    status = (
        F.when(F.col("_designs").isNull(), "no design")
        .when(F.col("n_positions").isNull(), "refused: no backbone")
        .when(F.col("_designs") > 1, "refused: repeated design")
        .when(~whole, "refused: positions are not 0 to n - 1")
        .when(F.col("n_letters").isNull() | (F.col("n_letters") != F.col("n_positions")), "refused: length differs")
        .otherwise(THREADED)
    )
    joined = letters.join(places, key, "full_outer").withColumn("status", status)
    return joined.select(key, F.col("n_letters").cast("bigint").alias("n_letters"), "n_positions", "status")


def threaded_letters(sequences: DataFrame, accounts: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, aa) of every letter of every threaded design. Accepted designs have a letter for
    each position, so letters are numbered where they are and never meet positions row by row."""
    accepted = accounts.where(F.col("status") == THREADED).select(key)
    return sequences.join(accepted, key, "left_semi").select(key, F.posexplode(F.split(seq, "")).alias("pos", "aa")).select(
        key, F.col("pos").cast("bigint").alias("pos"), "aa")


def _meeting(owner: np.ndarray, sign: np.ndarray, at: list[np.ndarray], cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of residues of opposite sign within the cutoff, each pair once. In the order of z a
    residue is compared with the next one, the one after, and so on while they lie in reach, so the
    work grows with the residues of one structure that are as close along that axis."""
    stands = np.flatnonzero(np.isfinite(at[2]))
    if not len(stands):
        return
    low, high, reach = at[2][stands].min(), at[2][stands].max(), cutoff * 1.000001
    # All structures behind each other on one axis, out of reach of one another: chains that stand in
    # order are runs, which a stable sort merges.
    line = owner[stands] * (high - low + 2 * reach) + (at[2][stands] - low)
    order = np.argsort(line, kind="stable")
    line, order = line[order], stands[order]
    o, s, (x, y, z) = owner[order], sign[order], (c[order] for c in at)
    reach += 4 * np.spacing(line[-1])
    near, i, step = len(order), None, 1  # the residues whose next one lies in reach, all or those at i
    while near and step < len(order):
        if i is None:
            close = line[step:] - line[:-step] <= reach
            near = np.count_nonzero(close)
            i = np.flatnonzero(close) if near * 8 < len(order) else None
            k = np.flatnonzero(close & (s[step:] != s[:-step]))
        else:
            i = i[: np.searchsorted(i, len(order) - step)]
            i = i[line[i + step] - line[i] <= reach]
            near = len(i)
            k = i[s[i] != s[i + step]]
        j = k + step
        dx, dy, dz = x[k] - x[j], y[k] - y[j], z[k] - z[j]
        met = (o[k] == o[j]) & (dx * dx + dy * dy + dz * dz <= cutoff * cutoff)
        yield order[k[met]], order[j[met]]
        step += 1


COUNTS = ["n_cationic", "n_anionic", "n_charged", "n_opportunities", "n_bridges", "n_engaged"]
SCOPES = ["all", "cross_chain"]


def _counted(owner: np.ndarray, sign: np.ndarray, chain: np.ndarray, stands: np.ndarray, at: list[np.ndarray], n: int, cutoff: float) -> np.ndarray:
    """COUNTS of each scope for n structures: an array of scopes, counts and structures. The residues
    at indices `stands` have a CB atom, which lies at `at`."""
    bridges, engaged = np.zeros((2, n), np.int64), np.zeros((2, len(owner)), bool)
    for i, j in _meeting(owner[stands], sign[stands], at, cutoff):
        i, j = stands[i], stands[j]
        cross = chain[i] != chain[j]
        for scope, (left, right) in enumerate(((i, j), (i[cross], j[cross]))):
            bridges[scope] += np.bincount(owner[left], minlength=n)
            engaged[scope, left] = engaged[scope, right] = True
    up, down = (np.bincount(owner[sign == s], minlength=n) for s in (1, -1))
    return np.array([[up, down, up + down, up * down, bridges[k], np.bincount(owner[engaged[k]], minlength=n)] for k in range(len(SCOPES))], np.int64)


def packed_bridges(packed: DataFrame, keys: Sequence[str], cutoff: float = 6.0) -> DataFrame:
    """(keys, scope, counts) from one row per structure with its `residues`, an array of different charged
    residues (chain, pos, sign, at), where `at` holds x, y and z and is null for a residue without a CB
    atom. Structures without a charged residue have no rows.

    The same counts as `spatial.scoped_counts` of `spatial.opposite_pairs`, without a shuffle:
    neither residues nor pairs leave the task that holds their structure.
    """
    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch["residues"]
        sizes, flat, n = np.diff(lists.offsets.to_numpy().astype(np.int64)), lists.flatten(), len(lists)
        owner, sign = np.repeat(np.arange(n), sizes), flat.field("sign").to_numpy(zero_copy_only=False)
        chain = flat.field("chain").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = flat.field("at")
        stands = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        at = [place.field(a).to_numpy(zero_copy_only=False)[stands] for a in "xyz"]
        some = pa.array(sizes > 0)
        for label, numbers in zip(SCOPES, _counted(owner, sign, chain, stands, at, n, cutoff), strict=True):
            columns = [*(batch[k] for k in keys), pa.array([label] * n), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "scope", *COUNTS]).filter(some)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema)
    counts = ", ".join(f"{n} bigint" for n in COUNTS)
    return packed.select(*keys, "residues").mapInArrow(lambda batches: (c for b in batches for c in count(b)), f"{shape}, scope string, {counts}")


class Backbone(NamedTuple):
    """Two chains of equal length as functions of arrays: the length for (key, number of letters), the
    native letters as bytes for (key, position, second chain or not), and x, y and z for (position,
    second chain or not). A glycine has no CB atom."""

    length: Callable[[np.ndarray, np.ndarray], np.ndarray]
    letter: Callable[[np.ndarray, np.ndarray, bool], np.ndarray]
    place: Callable[[np.ndarray, bool], Sequence[np.ndarray]]


# Bytes of text that are threaded at once: their residues stay in the processor's cache.
THREADED_BYTES = 1 << 18
_SIGN = np.zeros(256, np.int8)
_SIGN[[*b"KR"]], _SIGN[[*b"DE"]] = 1, -1


def threaded_bridges(texts: DataFrame, key: str, text: str, alphabet: str, backbone: Backbone, labels: Sequence[str], cutoff: float = 6.0) -> DataFrame:
    """(key, n_letters, found) for each text that holds letters of the alphabet, in either case: how many,
    and where the backbone has as many positions an array of (label, scope, counts). A `design` has its
    letters on the first chain and native ones on the second, `native` has native ones on both.

    Letters, places and pairs are arrays of the task that reads the text; one row per text leaves it.
    Keys are not compared: rows that repeat one are for the account to refuse.
    """
    letter_of = np.zeros(256, np.uint8)
    for a in alphabet:
        letter_of[ord(a.upper())] = letter_of[ord(a.lower())] = ord(a.upper())

    def threaded(structure: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
        """COUNTS per label and scope of designs that fit."""
        owner, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        pos = np.arange(len(owner)) - first[owner]
        native = lambda other, some=slice(None): backbone.letter(structure[owner[some]], pos[some], other)
        second, out = native(True), []
        for label in labels:
            owners, signs, chains, stand, at, before = [], [], [], [], [], 0
            for other, on in ((False, letters if label == "design" else native(False)), (True, second)):
                sign = _SIGN[on]
                charged = np.flatnonzero(sign)
                has_cb = np.flatnonzero(native(other, charged) != ord("G"))
                owners.append(owner[charged])
                signs.append(sign[charged])
                chains.append(np.full(len(charged), other))
                stand.append(has_cb + before)
                at.append(backbone.place(pos[charged[has_cb]], other))
                before += len(charged)
            joined = map(np.concatenate, (owners, signs, chains, stand))
            out += [*_counted(*joined, [np.concatenate(c) for c in zip(*at, strict=True)], len(n), cutoff)]
        return out

    parts = [(label, scope) for label in labels for scope in SCOPES]

    def chunk(keys: pa.Array, data: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        codes = letter_of[data]
        held = codes != 0
        n = np.diff(np.concatenate([[0], np.cumsum(held)])[ends])
        structure = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fits = (n > 0) & (backbone.length(structure, n) == n)
        letters = codes[held][np.repeat(fits, n)]
        numbers = np.array(threaded(structure[fits], n[fits], letters)).transpose(2, 0, 1)  # structures, parts, counts
        some = numbers[:, :, COUNTS.index("n_charged")] > 0
        names = [np.broadcast_to(np.array([part[k] for part in parts], object), some.shape)[some] for k in (0, 1)]
        flat = numbers[some]
        rows = pa.StructArray.from_arrays([*(pa.array(x, pa.string()) for x in names), *(pa.array(flat[:, k]) for k in range(len(COUNTS)))], ["label", "scope", *COUNTS])
        sizes = np.zeros(len(n), np.int32)
        sizes[fits] = some.sum(1)
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows)
        return pa.RecordBatch.from_arrays([keys, pa.array(n), found], [key, "n_letters", "found"]).filter(pa.array(n > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch[text].fill_null("").cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            low = 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + THREADED_BYTES, "right")) - 1)
                yield chunk(batch[key].slice(low, high - low), data[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
                low = high

    kind = texts.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c}: bigint" for c in COUNTS)
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_letters bigint, found array<struct<label: string, scope: string, {counts}>>")
