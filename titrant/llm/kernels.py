"""Vectorised hashing of words and of runs of tokens over Arrow text columns.

A batch of texts is one byte buffer with offsets, so whole batches are hashed at once without a
Python step per document. Polynomial prefix sums modulo 2**64 give the hash of any span in constant
time: every byte (or token) is first replaced by a random-looking 64-bit value, and results pass a
mixing function. All values are fixed by constants, so they agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(salt: int, lower: bool) -> np.ndarray:
    """One 64-bit value per byte; with `lower`, A-Z share the values of a-z."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * salt + 17))
    if lower:
        table[65:91] = table[97:123]
    return table


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASE]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, joined, and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slabs(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, so that working arrays stay small."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each text."""
    n = len(data)
    inside = ~gaps[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    table, out = byte_values(salt, lower), np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        up, down = _POWERS[salt & 1].get(int(ends[high - 1] - base) + 1)
        sums = np.zeros(int(ends[high - 1] - base) + 1, np.uint64)
        np.cumsum(table[data[base : ends[high - 1]]] * up[:-1], out=sums[1:])
        a, b = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (sums[b] - sums[a]) * down[a]
        low = high
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(tokens: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The hash of tokens[i : i + length] for every i where it fits, over the whole array."""
    n = len(tokens)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[salt & 1].get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def fitting(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run of `length` tokens stays within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return first[owner] + (np.arange(counts.sum()) - begins[owner]), owner


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each window of `width`, the rightmost of equal ones.

    Works by doubling: the least of a window is the least of two overlapping windows half as wide.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[left] < values[right], left, right)
        span += step
    return best[:n]


def overlaps(values: np.ndarray, owner: np.ndarray, n: int, m: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The number of different values of each of n + m sets, and how many each of the first n shares
    with each of the others. Values that one side alone holds are only counted; the others pass
    `columns` at a time, so memory does not grow with the number of values times that of sets."""
    names, at = np.unique(values, return_inverse=True)
    pairs = np.unique(at.reshape(-1) * (n + m) + owner)
    at, owner = pairs // (n + m), pairs % (n + m)
    sizes, sides = np.bincount(owner, minlength=n + m), np.zeros((2, len(names)), bool)
    sides[(owner >= n).astype(np.int64), at] = True
    shared = sides.all(axis=0)
    kept = shared[at]
    at, owner = (np.cumsum(shared) - 1)[at[kept]], owner[kept]
    both = np.zeros((n, m), np.float32)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(at, (low, low + columns))
        held = np.zeros((n + m, int(at[b - 1]) - low + 1), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        both += held[:n] @ held[n:].T
    return sizes, both
