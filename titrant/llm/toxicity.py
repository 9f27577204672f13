"""Toxicity by a bidirectional gated recurrent network with attention over words and characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from titrant.llm import kernels
from titrant.llm.shared import back_to_id, row_id

#: Words of a window, and from one window's start to the next: every word but the first few of a
#: text stands in two windows.
WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTEND, NGRAM = 1 << 14, 1 << 14, 16, 8, 8, 5
#: Training reads at most this many labelled rows of each class, with whole texts of any length.
TRAIN_TOXIC, TRAIN_OTHER = 800, 1_600
#: Steps of training, the same at any number of rows; texts of a step; windows of a text that a step
#: learns from besides the highest one.
STEPS, BATCH, OTHER_WINDOWS = 640, 32, 6
#: Bytes of texts that a task scores at once; a single longer text is a block of its own.
SCORED = 1 << 19

_GAPS = np.ones(256, bool)
_GAPS[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


@dataclass
class Tokens:
    """Texts as numbers: the distinct words, which word stands where, and where each text begins."""

    rows: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    words: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, first = kernels.word_spans(data, offsets, _GAPS)
    hashes = kernels.span_hashes(data, starts, ends, lower=True)
    distinct, example, words = np.unique(hashes, return_index=True, return_inverse=True)
    # Distinct words with a mark on either side, one after the other, for runs of characters.
    lengths = ends[example] - starts[example] + 2
    begin = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths)
    source = np.repeat(starts[example] - 1, lengths) + at
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    marked = np.where(
        (at == 0) | (at == np.repeat(lengths - 1, lengths)), np.uint8(0), lowered[data[np.clip(source, 0, max(len(data) - 1, 0))]]
    ) if len(data) else np.zeros(0, np.uint8)
    runs = kernels.run_hashes(kernels.mix(marked.astype(np.uint64) + np.uint64(5)), NGRAM)
    places, owner = kernels.fitting(begin, NGRAM)
    counts = np.bincount(owner, minlength=len(distinct))
    return Tokens(
        (distinct % np.uint64(WORD_ROWS)).astype(np.int64), (runs[places] % np.uint64(CHAR_ROWS)).astype(np.int64),
        np.concatenate(([0], np.cumsum(counts))), words.reshape(-1), first,
    )


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of every window; a text of any length is covered to its end."""
    sizes = np.diff(first)
    counts = np.where(sizes == 0, 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(sizes)), counts)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    at = (np.arange(counts.sum()) - begins[text]) * STRIDE
    return first[text] + at, np.minimum(WINDOW, sizes[text] - at), text


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of `rows` by their place `at` in an array of n rows."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        placed = at[order]
        starts = np.flatnonzero(np.concatenate(([True], placed[1:] != placed[:-1])))
        out[placed[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


@dataclass
class Network:
    p: dict[str, np.ndarray]
    shift: float = 0.0
    _adam: dict = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s, f=0.1: (r.standard_normal(s) * f).astype(np.float32)
        p = {"word": n(WORD_ROWS, WIDTH), "char": n(CHAR_ROWS, WIDTH), "att": n(2 * HIDDEN, ATTEND, f=0.3), "att_b": np.zeros(ATTEND, np.float32),
             "att_v": n(ATTEND, f=0.3), "out": n(2 * HIDDEN, f=0.3), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": n(2 * WIDTH, 3 * HIDDEN, f=0.25), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"rec_{d}": n(HIDDEN, 3 * HIDDEN, f=0.25)}
        return Network(p)

    def inputs(self, t: Tokens, some: np.ndarray | None = None) -> np.ndarray:
        """The input of each distinct word: its own vector beside the mean of its character runs."""
        out = np.zeros((len(t.rows), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.p["word"][t.rows]
        full = np.flatnonzero(np.diff(t.gram_first))
        for low in range(0, len(full), 20_000):
            part = full[low : low + 20_000]
            a, b = t.gram_first[part[0]], t.gram_first[part[-1] + 1]
            sums = np.add.reduceat(self.p["char"][t.grams[a:b]], t.gram_first[part] - a, axis=0)
            out[part, WIDTH:] = sums / np.diff(t.gram_first)[part, None]
        return out

    def _run(self, gx: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """One direction over (steps, windows, 3 * HIDDEN); the states of all steps."""
        u, steps = self.p[f"rec_{d}"], gx.shape[0]
        h, out = np.zeros((gx.shape[1], HIDDEN), np.float32), np.empty((steps, gx.shape[1], HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gh = h @ u
            zr = _sigmoid(gx[t, :, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gx[t, :, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            after = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, gh[:, 2 * HIDDEN :], m))
            h = out[t] = after
        return out

    def forward(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit per window; ids and mask are (steps, windows)."""
        states = []
        for d in "fb":
            log = None if keep is None else keep.setdefault(d, [])
            states.append(self._run(projected[d][ids], mask, d, log))
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ self.p["att"] + self.p["att_b"])
        e = np.where(mask > 0, a @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        c = (alpha[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "a": a, "alpha": alpha, "c": c}
        return c @ self.p["out"] + self.p["out_b"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}

    def gradients(self, t: Tokens, x, ids, mask, keep, g) -> dict[str, np.ndarray]:
        """Gradients of all parameters, from `g`, the gradient of each window's logit."""
        p, out = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        h, a, alpha, c = keep["h"], keep["a"], keep["alpha"], keep["c"]
        out["out"], out["out_b"][0] = c.T @ g, g.sum()
        dc = g[:, None] * p["out"]
        dalpha = (h * dc[None]).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        out["att_v"] = np.einsum("tb,tbk->k", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        out["att"], out["att_b"] = np.einsum("tbh,tbk->hk", h, da), da.sum(axis=(0, 1))
        dh_all = alpha[:, :, None] * dc[None] + da @ p["att"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            own, u = dh_all[:, :, i * HIDDEN : (i + 1) * HIDDEN], p[f"rec_{d}"]
            dgx, dh = np.empty((*ids.shape, 3 * HIDDEN), np.float32), np.zeros((ids.shape[1], HIDDEN), np.float32)
            for step, h0, z, r, n, ghn, m in reversed(keep[d]):
                dh = dh + own[step]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = -dh * m * (n - h0) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgx[step] = np.concatenate([dz, dr, dn], axis=1)
                dgh = np.concatenate([dz, dr, dn * r], axis=1)
                out[f"rec_{d}"] += h0.T @ dgh
                dh = dh * (1 - m * (1 - z)) + dgh @ u.T
            flat = dgx.reshape(-1, 3 * HIDDEN)
            per_word = _summed(flat, ids.reshape(-1), len(x))
            out[f"bias_{d}"], out[f"in_{d}"] = flat.sum(axis=0), x.T @ per_word
            dx += per_word @ p[f"in_{d}"].T
        touched = np.flatnonzero(dx.any(axis=1))
        out["word"] = _summed(dx[touched, :WIDTH], t.rows[touched], WORD_ROWS)
        counts = np.diff(t.gram_first)
        each = dx[touched, WIDTH:] / np.maximum(counts[touched], 1)[:, None]
        owner = np.repeat(np.arange(len(touched)), counts[touched])
        grams = t.grams[np.repeat(dx.any(axis=1), counts)]
        out["char"] = _summed(each[owner], grams, CHAR_ROWS)
        return out

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        n = self._adam["n"] = self._adam.get("n", 0) + 1
        for k, g in grads.items():
            m, v = self._adam.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self._adam[k] = (m, v)
            self.p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)).astype(np.float32)

    def text_logits(self, data: np.ndarray, offsets: np.ndarray, block: int = 4096) -> np.ndarray:
        """The highest window logit of each text; minus infinity for a text without words."""
        t = tokens(data, offsets)
        projected = self.project(self.inputs(t))
        start, length, text = windows(t.first)
        best = np.full(len(t.first) - 1, -np.inf, np.float32)
        for low in range(0, len(start), block):
            ids, mask = batch_ids(t, start[low : low + block], length[low : low + block])
            np.maximum.at(best, text[low : low + block], self.forward(projected, ids, mask))
        return best


def batch_ids(t: Tokens, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)[:, None]
    mask = steps < length[None]
    return t.words[np.where(mask, start[None] + steps, start[None])], mask.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network | None:
    """Learns from whole texts: of a toxic text the window that scores highest is toxic (in the
    first steps others too, lightly); of a clean one the highest and some others are clean.

    A quarter of the rows is set aside to place the threshold between the classes. None where only
    one class is given.
    """
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return None
    r, net = np.random.default_rng(seed), Network.new(seed)
    order = r.permutation(len(texts))
    aside = [i for i in order[: len(order) // 4]]
    learn = np.array([i for i in order[len(order) // 4 :]])
    if len(set(labels[learn].tolist())) < 2 or len(texts) < 40:
        learn, aside = order, list(order)
    share = max(labels[learn].mean(), 1e-3)
    done, first_round = 0, max(1, steps // 10)
    while done < steps:
        for low in range(0, len(learn), BATCH):
            if (done := done + 1) > steps:
                break
            part, early = learn[low : low + BATCH], done <= first_round
            data, offsets = kernels.text_bytes(pa.array([texts[i] for i in part], pa.large_string()))
            t = tokens(data, offsets)
            start, length, text = windows(t.first)
            if not len(start):
                continue
            x = net.inputs(t)
            projected, weight = net.project(x), np.zeros(len(start), np.float32)
            # All windows are scored; the gradient follows the worst of each text and a few others.
            logits = np.concatenate([
                net.forward(projected, *batch_ids(t, start[a : a + 4096], length[a : a + 4096])) for a in range(0, len(start), 4096)
            ])
            for k, own in enumerate(np.split(np.arange(len(start)), np.searchsorted(text, np.arange(1, len(part))))):
                if not len(own):
                    continue
                toxic = labels[part[k]] == 1
                some = r.permutation(own)[:OTHER_WINDOWS]
                scale = 1.0 / share if toxic else 1.0 / (1 - share)
                weight[some] += scale / len(some) * (0.3 if early else 0.0) if toxic else scale / len(some)
                weight[own[np.argmax(logits[own])]] += scale
            used = np.flatnonzero(weight)
            ids, mask = batch_ids(t, start[used], length[used])
            keep: dict = {}
            logits = net.forward(projected, ids, mask, keep)
            g = ((_sigmoid(logits) - labels[part][text[used]]) * weight[used] / len(part)).astype(np.float32)
            net.step(net.gradients(t, x, ids, mask, keep, g), 0.01 * (1 - 0.9 * done / steps))
        r.shuffle(learn)
    data, offsets = kernels.text_bytes(pa.array([texts[i] for i in aside], pa.large_string()))
    scores = np.concatenate([net.text_logits(data[offsets[a]:offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernels.slabs(offsets)])
    net.shift = threshold(np.where(np.isfinite(scores), scores, -20), labels[aside])
    net._adam = {}
    return net


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors; of several, the middle of the widest gap."""
    order = np.argsort(scores)
    s, y = scores[order].astype(float), labels[order]
    wrong = np.concatenate(([(y == 0).sum()], (y == 0).sum() + np.cumsum(np.where(y == 1, 1, -1))))
    edges = np.concatenate(([s[0] - 4], s, [s[-1] + 4]))
    gaps = np.diff(edges)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _in_fold(column: str = "doc_id"):
    """Whether a row is held out of training."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains on a bounded sample: the labelled rows outside the held-out fold that come first by a
    hash of doc_id, at most TRAIN_TOXIC and TRAIN_OTHER of them. The number of texts is fixed, so the
    driver holds as many at any size of the tables."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_in_fold()).select("doc_id", "toxic").distinct()
    picked = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(n)
        for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER))
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .join(sample, "doc_id").orderBy("doc_id", "text").limit(TRAIN_TOXIC + TRAIN_OTHER).collect()
    )
    return train([x["text"] for x in rows], np.array([x["toxic"] for x in rows], np.int64)) if rows else None


def scores(texts: pa.Array, net: Network | None) -> np.ndarray:
    """The score of each text, SCORED bytes of them at a time."""
    out = np.zeros(len(texts))
    if net is not None and len(texts):
        data, offsets = kernels.text_bytes(texts)
        for a, b in kernels.slabs(offsets, SCORED):
            logits = net.text_logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] = np.where(np.isfinite(logits), _sigmoid(logits.astype(float) - net.shift), 0.0)
    return out


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """Adds `score` (0 to 1) behind all columns of `docs`, as (row, id, score).

    Tasks read the texts as Arrow holds them, a bounded part at a time, and make no Python strings.
    A text scores as its worst window. Without words the score is 0; without a network (no labelled
    rows, or one class only) every score is 0. A null counts as an empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts, shared.value))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(score, "double")
    return docs.select(F.struct("*").alias("row"), row_id().alias("id"), F.col("text").cast("string").alias("_t")).select(
        "row", "id", udf("_t").alias("score")
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`. Scores depend on the text alone. A missing doc_id is not held out."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        back_to_id("id").alias("doc_id"), _in_fold("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the network does not call toxic, all columns kept."""
    return scored(docs, fit(docs, labels)).where("score < 0.5").select("row.*")
