"""The whole pipeline on a small corpus, against its stages by plain loops."""

import random
import re

import pytest

import corpus_pipeline
from titrant.llm import decontamination, lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, th string, row string, size string"


def _corpus():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared, item = say(14), say(24)
    texts = ["\n".join(say(r.randint(8, 14)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    texts += [f"{say(12)}\n{shared}\n{say(9)}" for _ in range(6)]
    texts += [texts[3], texts[3] + " " + word(), texts[4].upper()]
    texts += [f"{say(9)} {' '.join(item.split()[4:16])} {say(5)}", f"{say(4)}, {item.upper()}!"]
    texts += ["", "  \n\t", None, shared, "Read more", f"{say(10)}\nread  MORE", texts[7], None]
    rows = [(None if i in (8, 44) else i, t, "en", [None, "a", "b"][i % 3], len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[10], (11, say(20), "en", "a", 5, "x", "x", "x", "x")], item


def _shingles(text, n, units):
    return {tuple(units[i : i + n]) for i in range(len(units) - n + 1)} or ({tuple(units)} if units else set())


def _alike(a, b):
    return a and b and 100 * len(a & b) >= 75 * len(a | b)


def _groups(sets):
    """The first place of each place's component."""
    up = list(range(len(sets)))
    top = lambda x: x if up[x] == x else top(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if _alike(a, sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i in range(len(sets))]


def _order(row, th):
    return (row[0] is None, row[0] or 0, th)


def _expected(rows, item, hashes):
    """(doc_id, words) that reach the mix. Rows that share an id go by a hash of their texts."""
    rows = sorted(rows, key=lambda x: _order(x, hashes[x[1]]))
    placed = [(i, k, x) for i, row in enumerate(rows) for k, x in enumerate((row[1] or "").split("\n")) if lines.normal(x)]
    normal = [lines.normal(x) for _, _, x in placed]
    own = [_shingles(None, 5, x) if len(x) >= lines.MIN_CHARS else {("short", x)} for x in normal]
    gone = set()
    for n, first in enumerate(_groups(own)):
        a, b = placed[n], placed[first]
        # Rows that are the same in id and text share one decision.
        if first != n and (rows[a[0]][:2] != rows[b[0]][:2] or a[1] != b[1]):
            gone.add((a[0], a[1]))
    kept = []
    for i, row in enumerate(rows):
        left = [x for k, x in enumerate((row[1] or "").split("\n")) if (i, k) not in gone]
        changed = any(g[0] == i for g in gone)
        text = None if row[1] is None else "\n".join(left)
        if not changed or re.search(r"[^ \t-\r]", text):
            kept.append((row[0], text))
    words = [re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) for _, t in kept]
    group = _groups([_shingles(None, 5, w) for w in words])
    one = [k for n, k in enumerate(kept) if group[n] == n and k not in kept[:n]]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wanted = {tuple(plain(item)[i : i + 10]) for i in range(len(plain(item)) - 9)}
    clean = [(i, t) for i, t in one if not wanted & {tuple(plain(t)[k : k + 10]) for k in range(len(plain(t)))}]
    return sorted((i is None, i or 0, len(re.findall(r"[^ \t-\r]+", t or ""))) for i, t in clean)


def _tables(spark, folder, rows, items):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string, id string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_is_that_of_its_stages(spark, tmp_path):
    rows, item = _corpus()
    folder = _tables(spark, tmp_path / "some", rows, [(1, item, "x"), (None, None, "x")])
    from pyspark.sql import functions as F

    hashes = {x.text: x.h for x in spark.createDataFrame(rows, DOCS).select("text", F.xxhash64("text").alias("h")).collect()}
    mix = corpus_pipeline.run(spark, folder).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size) for x in mix) == _expected(rows, item, hashes)
    for source in {x.source for x in mix}:
        own = [x for x in mix if x.source == source]
        assert sum(x.size for x in own) == own[0].source_size
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
        assert all(x.taken <= 3 * x.size for x in own)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, item = _corpus()
    folder = _tables(spark, tmp_path / "some", rows, [(1, item, "x")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x", "x", "x", "x")]])
def test_empty_and_null_rows(spark, tmp_path, rows):
    folder = _tables(spark, tmp_path / "none", rows, [])
    got = corpus_pipeline.run(spark, folder).collect()
    assert [(x.doc_id, x.size, x.taken) for x in got] == [(None, 0, 0)] * len(rows)
    assert decontamination.WINDOW == 10
