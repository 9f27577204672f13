"""Importance resampling, prefix encoding and collocations: against SQL, the tokenizer library and
plain loops, on rows with every awkward case."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from titrant.llm import collocations, importance, kernels, prefix_bpe, sql

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, th string, bucket string, w0 string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    phrase, out = "Über the quick brown fox", []
    for i in range(150):
        out.append(f"{say(r.randint(0, 15))} {phrase}\t{say(3)}, quick brown. {say(4)}\x0cnew york city\n{phrase.upper()}")
    out += ["", " ", "...", None, "one", "a-b_c d", "x" * 3000, "ÉÉ " * 200, say(19), say(20), "\x00\x1fa b c", "ΣΑΣ ΌΣΟΣ", "<|endoftext|> it's I'LL 12 ½"]
    return out + out[:3]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(None if i in (5, 9) else i // 2 if i > 160 else i, t, [None, "en", "de"][i % 3], "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def _same(df, statement, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    cursor = con.execute(statement)
    columns = [d[0] for d in cursor.description]
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(cursor.fetchall())


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "the quick brown fox jumps"), (None, "New York"), (3, None), (4, ""), (4, "new york city")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_drawn_rows(docs, benchmark, monkeypatch):
    columns = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    _same(importance.digest(docs, benchmark), sql.DRAWN, documents=columns[0], benchmark=columns[1])
    drawn = {r.doc_id for r in importance.digest(docs, benchmark).where("rank is not null").collect()}
    kept = importance.resampled(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn
    monkeypatch.setattr(importance, "_AT_ONCE", 7)
    _same(importance.digest(docs, benchmark), sql.DRAWN, documents=columns[0], benchmark=columns[1])


def test_feature_spans():
    line = importance.collapsed("..A b--Cé!")
    assert [line[a:b].decode() for a, b in importance.spans("..A b--Cé!", 3)] == ["a", "a b", "a b cé", "b", "b cé", "cé"]
    text = " ".join(str(i % 700) for i in range(3000))
    words = text.split()
    want = Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 50 for n in (1, 2, 3) for i in range(len(words) - n + 1))
    _, total, places, counts = importance._counted(text, importance._grams(3), 50)
    assert total == sum(want.values()) and dict(zip(places.tolist(), counts.tolist(), strict=True)) == want


def test_empty_tables(spark, docs, benchmark):
    none = spark.createDataFrame([], DOCS)
    assert importance.digest(none, benchmark).count() == 0 and prefix_bpe.digest(none, TOKENIZER).count() == 0
    assert collocations.mined(none).count() == 0
    assert importance.digest(docs, benchmark.limit(0)).count() == docs.count()


def test_encoding_is_the_librarys(docs):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for row in docs.select("doc_id", "text").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want[row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in prefix_bpe.digest(docs, TOKENIZER).collect()) == want
    rows = prefix_bpe.decoded(prefix_bpe.encoded(docs, TOKENIZER), TOKENIZER).collect()
    assert len(rows) == len(_texts()) and all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_encoding_of_random_words():
    library, own, r = Tokenizer.from_file(TOKENIZER), prefix_bpe.encoder(open(TOKENIZER, encoding="utf-8").read()), random.Random(3)
    tokens = [t.removesuffix("</w>") for t in random.Random(4).sample(sorted(library.get_vocab()), 400)]
    for _ in range(1500):
        text = "".join(r.choice(tokens) if r.random() < 0.5 else r.choice("abeinorst'’1É漢😀Σ́ ") for _ in range(r.randint(1, 12)))
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids, text
    text = "abracadabra " * 120_000 + "x" * 70_000
    assert own.digests(text)[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_every_token_is_its_own_encoding():
    """What the last token of a prefix rests on: a token's text is encoded as that token."""
    own = prefix_bpe.encoder(open(TOKENIZER, encoding="utf-8").read())
    ends = [t for t, s in own.vocabulary.symbols.items() if s[-1] >= 256]
    for token in ends[::37]:
        word = bytes(s % 256 for s in own.vocabulary.symbols[token])
        try:
            assert own.encode(word.decode()) == [token]
        except UnicodeDecodeError:
            continue


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_collocations(docs, monkeypatch, bits):
    """With a filter that holds the frequent pairs, and with one so small that it lets all pass."""
    monkeypatch.setattr(kernels, "_CHUNK", 97)
    found = collocations.mined(docs, bits=bits)
    assert found.count() > 5
    _same(found, sql.COLLOCATIONS, documents=docs.select("doc_id", "text", "lang"))


def test_collocations_of_few(spark):
    rows = [(1, "a b c. a b", "en"), (2, "A b c d", "en"), (3, "a b", None), (4, None, "en"), (5, "", "fr"), (6, "a b! c", "und")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, least=1).collect()}
    assert got[("en", "a b")] == (3, 3, 3, 9, 3000) and got[("und", "a b")] == (2, 2, 2, 5, 2500)
    assert got[("en", "a b c d")][:1] == (1,) and ("en", "b c d") not in got and ("en", "b c") not in got
    assert ("en", "a b c") in got and not [k for k in got if k[0] == "fr"]
    big = spark.createDataFrame([("en", 1, ["x"], 9 * 10**15), ("en", 1, ["y"], 9 * 10**15), ("en", 0, [], 9 * 10**16), ("en", 2, ["x", "y"], 8 * 10**15)], "lang string, k int, words array<string>, f bigint")
    score = collocations._scored(big).first()
    assert score.score == 1000 * 8 * 10**15 * 9 * 10**16 // (9 * 10**15) ** 2
    assert np.iinfo(np.int64).max < 8 * 10**15 * 9 * 10**16
