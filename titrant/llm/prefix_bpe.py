"""Byte-pair encoding by the unique last token of every prefix, and its decoding.

A byte-pair encoding never changes to the left of a place where it may be cut, so each prefix of a
word has exactly one last token: the one token that ends there and can follow the last token of what
stands before it. Two tokens can follow each other when no merge across their border would have come
before the merges that made them. One pass over a word therefore fixes its encoding in time linear in
its length, whatever order the merges are listed in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from titrant.llm.shared import back_to_id, by_batch, keyed_texts, row_id

#: Runs and words whose encoding a worker keeps, and border tests it keeps; both start anew when full.
KEPT_RUNS, KEPT_BORDERS = 500_000, 1_000_000
#: Characters that are split at spaces at once, so that a long text needs no list of its words.
_AT_ONCE = 1_000_000
_END = 256
_MARKS = tuple(".,;:!?")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, otherwise the
    next unused one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Kinds(dict):
    """For `str.translate`: each character beyond ASCII becomes a well-known one of its kind (letter,
    number, blank or other), as the tokenizer's own tables see it, which may be of another Unicode
    version than ours."""

    def __init__(self, pattern: str):
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str

    def __missing__(self, point: int) -> int:
        x = chr(point)
        if point < 128:
            kind = x
        elif not self.split(x):
            kind = " "
        elif len(self.split("a" + x)) == 1:
            kind = "\u00e9"
        else:
            kind = "\u00a1" if len(self.split("!" + x)) == 1 else "\u00b2"
        return self.setdefault(point, ord(kind))


class Vocabulary:
    """Tokens and merges of a byte-level tokenizer file whose words end in a suffix.

    Refuses files with parts that this encoder does not follow, instead of encoding them otherwise.
    """

    def __init__(self, text: str):
        whole = json.loads(text)
        model, steps = whole["model"], whole["pre_tokenizer"]["pretokenizers"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        kinds = [n["type"] for n in whole["normalizer"]["normalizers"]]
        if odd or kinds != ["NFC", "Replace", "Lowercase"] or whole["decoder"] is not None or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"not a lower-casing word tokenizer with plain merges: {odd} {kinds}")
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.kinds = _Kinds(steps[0]["pattern"]["Regex"])
        self.normal = Tokenizer.from_str(text).normalizer.normalize_str
        self.added = {a["content"]: a["id"] for a in whole["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.added)) or "(?!)")
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        ids = model["vocab"]
        letters = _byte_letters()
        #: Token of each symbol: a byte, or a byte that ends its word.
        self.single = [ids[x] for x in letters] + [ids[x + self.suffix] for x in letters]
        self.symbols: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(self.single)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = ids[a], ids[b]
            made = ids[a + b]
            self.rank[left, right] = rank
            self.parts.setdefault(made, (rank, left, right))
            self.symbols.setdefault(made, self.symbols[left] + self.symbols[right])


class SuffixAutomaton:
    """The suffix automaton of all tokens: the state reached by a text stands for the longest of its
    ends that occurs in some token, and suffix links lead to the shorter ones. A token that occurs
    anywhere is the longest string of a state of its own, since it also begins somewhere."""

    def __init__(self, tokens: dict[int, tuple[int, ...]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size, self.token = [-1], [0], [-1]
        for name, symbols in tokens.items():
            last = 0
            for symbol in symbols:
                last = self._add(last, symbol)
            self.token[last] = name
        #: The nearest state on the way along suffix links, itself included, that is a token.
        self.near = [0] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.near[state] = state if self.token[state] >= 0 else self.near[self.link[state]]
        self.shorter = [self.near[up] if up > 0 else 0 for up in self.link]

    def _state(self, size: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.token.append(-1)
        return len(self.size) - 1

    def _split(self, state: int, symbol: int, to: int) -> int:
        """A state for the shorter strings of `to`, which from now on have more ends than its longest."""
        copy = self._state(self.size[state] + 1, dict(self.go[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.go[state].get(symbol) == to:
            self.go[state][symbol] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, symbol: int) -> int:
        to = self.go[last].get(symbol)
        if to is not None:
            return to if self.size[to] == self.size[last] + 1 else self._split(last, symbol, to)
        new = self._state(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and symbol not in self.go[state]:
            self.go[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            to = self.go[state][symbol]
            self.link[new] = to if self.size[to] == self.size[state] + 1 else self._split(state, symbol, to)
        return new


class Encoder:
    """Encodes words by the last token of each prefix; keeps what it has found within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = SuffixAutomaton(vocabulary.symbols)
        self.runs: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, list[int]] = {}
        self.borders: dict[int, bool] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined text is these two tokens.

        Undoes the merges of both, latest first. Between what then touches the border, a merge that
        ranks before the undone one would have been made instead; one of equal rank as well where
        the undone merge stands to its right, since equal merges are made from the left.
        """
        if len(self.borders) >= KEPT_BORDERS:
            self.borders.clear()
        known = self.borders[left << 20 | right] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        rank, parts = self.vocabulary.rank, self.vocabulary.parts
        a, b = left, right
        before = len(rank)
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and of_a[0] > of_b[0]):
                before, _, a = of_a
            else:
                before, b = of_b[0] + 1, of_b[1]

    def encode(self, word: str) -> list[int]:
        """Token ids of one word of normalised text."""
        symbols = list(word.encode())
        if not symbols:
            return []
        symbols[-1] += _END
        auto, borders, follows = self.automaton, self.borders, self.follows
        go, link, size, near, shorter, token = auto.go, auto.link, auto.size, auto.near, auto.shorter, auto.token
        last: list[int] = []
        begins: list[int] = []
        at, length = 0, 0
        for place, symbol in enumerate(symbols):
            # The longest end of the prefix that occurs in some token, then the longest token in it.
            to = go[at].get(symbol)
            while to is None and at:
                at = link[at]
                length = size[at]
                to = go[at].get(symbol)
            if to is not None:
                at = to
                length += 1
            # What was read may be shorter than the longest string of its state.
            state = near[at] if size[at] == length else near[link[at]]
            while state:
                right, begin = token[state], place - size[state]
                if begin < 0:
                    break
                pair = last[begin] << 20 | right
                known = borders.get(pair)
                if known or (known is None and follows(last[begin], right)):
                    break
                state = shorter[state]
            else:
                raise ValueError(f"no token ends at byte {place} of {word[:50]!r}")
            last.append(right)
            begins.append(begin)
        found, end = [], len(last) - 1
        while end >= 0:
            found.append(last[end])
            end = begins[end]
        return found[::-1]

    def known(self, run: str) -> tuple[int, str, str]:
        """Number of tokens of a run without spaces, its ids and its decoded form, both joined by
        spaces. Neither words nor normalisation reach across a space, so runs stand for themselves."""
        found = self.runs.get(run)
        if found is None:
            ids = self.ids(run)
            found = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(self.runs) >= KEPT_RUNS:
                self.runs.clear()
            if len(run) < 256:
                self.runs[run] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of token ids. The file names no decoder, so tokens are joined by spaces and keep
        their byte letters and word ends."""
        return " ".join(self.vocabulary.names[i] for i in ids)

    def split(self, text: str) -> Iterator[str | int]:
        """The words of a text, normalised, and the ids of added tokens that stand in it as such."""
        low = 0
        for match in self.vocabulary.special.finditer(text):
            yield from self._split(text[low : match.start()])
            yield self.vocabulary.added[match[0]]
            low = match.end()
        yield from self._split(text[low:] if low else text)

    def _split(self, text: str) -> Iterator[str]:
        if text.isascii():
            # Letters alone, or letters and one mark, need no pattern to part them.
            if text.isalpha():
                yield text.lower()
                return
            if text[:-1].isalpha() and text[-1:] in _MARKS:
                yield text[:-1].lower()
                yield text[-1]
                return
            for match in self.vocabulary.pattern.finditer(text.lower()):
                yield match[0]
            return
        text = self.vocabulary.normal(text)
        for match in self.vocabulary.pattern.finditer(text.translate(self.vocabulary.kinds)):
            yield text[match.start() : match.end()]

    def ids(self, text: str) -> list[int]:
        found: list[int] = []
        for word in self.split(text):
            if isinstance(word, int):
                found.append(word)
                continue
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= KEPT_RUNS:
                    self.words.clear()
                ids = self.encode(word)
                if len(word) < 256:
                    self.words[word] = ids
            found += ids
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and hashes of the ids and of the decoded text."""
        n, ids, decoded, low = 0, hashlib.sha256(), hashlib.sha256(), 0
        get, known = self.runs.get, self.known
        while low < len(text):
            high = text.find(" ", low + _AT_ONCE)
            part = text[low : high if high >= 0 else len(text)].split(" ")
            low = high + 1 if high >= 0 else len(text)
            found = [f for f in [get(run) or known(run) for run in part if run] if f[0]]
            if found:
                gap = " " if n else ""
                n += sum([f[0] for f in found])
                ids.update((gap + " ".join([f[1] for f in found])).encode())
                decoded.update((gap + " ".join([f[2] for f in found])).encode())
        return n, ids.hexdigest(), decoded.hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    """The encoder of a tokenizer file, built once per worker process."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(Vocabulary(text))
    return _ENCODERS[name]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(row, ids) for every row of `docs`: its token ids; `row` holds all its columns.

    `path` names a tokenizer file that the driver can read; its content, a few megabytes at any size
    of the data, is sent to the tasks, which need no file. A null text has no ids.
    """
    held = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def work(batch: pa.RecordBatch):
        e = encoder(held.value)
        # Row by row, so that no more than one long text's ids are held at once.
        for i in range(batch.num_rows):
            ids = e.ids(batch["text"][i].as_py() or "")
            yield pa.RecordBatch.from_arrays([batch["row"].slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["row", "ids"])

    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kind = whole.schema["row"].dataType.simpleString()
    return by_batch(whole, work, f"row {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """`encoded` rows with the column `decoded`: the text that their ids stand for."""
    held = rows.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    @F.pandas_udf("string")
    def text_of(ids):
        e = encoder(held.value)
        return ids.map(lambda x: None if x is None else e.decode([int(i) for i in x]))

    return rows.withColumn("decoded", text_of("ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of `docs`: number of tokens, and hashes of the ids and of the decoded text.

    Null and empty texts have no tokens. Strings of special tokens inside a text are those tokens, as
    the file says. Repeated rows and ids each keep their row; a missing id stays missing; very long
    texts and words pass in pieces; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def work(batch: pa.RecordBatch):
        e = encoder(held.value)
        found = [e.digests(text.as_py() or "") for text in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = by_batch(
        docs.select(row_id().alias("id"), F.col("text").cast("string").alias("text")), work,
        "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
    return rows.select(back_to_id("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
