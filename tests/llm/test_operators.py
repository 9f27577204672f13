"""Operators against the contracts' SQL or brute force, on rows with every awkward case."""

import hashlib
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from titrant.llm import bottomk, components, decontamination, lines, mixing, personal, phrases, projections, sql, suffixes, toxicity, url_trust

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, th string, row string"


def _texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, base, out = say(80), say(120).split(), []
    for _ in range(12):
        out.append(say(r.randint(1, 90)))
    for _ in range(6):
        out.append(f"{say(20)}\n{shared} {say(15)}")
    for k in range(14):
        copy = list(base)
        for i in r.sample(range(120), k // 3):
            copy[i] = say(1)
        out.append(" ".join(copy))
    out += [out[0], out[0], base and " ".join(base), "", "   ", "word " * 130, "x" * 130, "é" * 60 + " Été É", shared.upper(), "é\x0b" + shared]
    out += ["a.b+c@d-e.fg.h_i@j.kl 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111-1111 1111 +49 (30) 1234567 +1-2", "9" * 40 + "@x", None]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "clash", "clash", "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def benchmark(spark, docs):
    words = [t for t in _texts() if t and len(t.split()) > 60][:3]
    rows = [(i, " ".join(w.split()[5 * i : 25 + 5 * i])) for i, w in enumerate(words)] + [(7, "abc"), (8, ""), (9, None), (10, "É")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def _same(df, statement, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toPandas())
    want = con.execute(statement).df()
    columns = sorted(want.columns)
    got = df.select(*columns).toPandas()
    key = lambda p: sorted(map(tuple, p[columns].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_phrases(docs):
    _same(phrases.digest(docs), sql.PHRASES, documents=docs.select("doc_id", "text"))


@pytest.mark.parametrize("hot", [50_000, 0])
def test_suffixes(docs, monkeypatch, hot):
    """Both ways for heads with many suffixes; small slabs and buckets put borders everywhere."""
    monkeypatch.setattr(suffixes, "SLAB_BYTES", 1500)
    monkeypatch.setattr(suffixes, "PRINT_BYTES", 500)
    monkeypatch.setattr(suffixes, "SUFFIXES", 40)
    monkeypatch.setattr(suffixes, "HOT_SUFFIXES", hot)
    _same(suffixes.digest(docs), sql.SUFFIXES, documents=docs.select("doc_id", "text"))


def test_leaks(docs, benchmark, monkeypatch):
    for rows in (50_000, 7):
        monkeypatch.setattr(decontamination, "BLOCK_ROWS", rows)
        _same(decontamination.digest(docs, benchmark), sql.LEAKS, documents=docs.select("doc_id", "text"), benchmark=benchmark)
    kept = {r.doc_id for r in decontamination.clean(docs, benchmark).collect()}
    assert kept == {r.doc_id for r in decontamination.digest(docs, benchmark).where("not contaminated").collect()}


@pytest.mark.parametrize("chunk", [256, 3])
def test_near_duplicates(docs, monkeypatch, chunk):
    monkeypatch.setattr(bottomk, "CHUNK", chunk)
    _same(bottomk.digest(docs), sql.NEAR, documents=docs.select("doc_id", "text"))
    assert bottomk.one_of_each(docs).columns == docs.columns


def test_near_duplicates_without_ids(spark):
    """Missing ids join nothing; a repeated id stands for each of its texts; of equal rows one stays."""
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    base, other, third, fourth = (say(60) for _ in range(4))
    rows = [(1, base), (None, base + " more"), (None, other), (None, third), (7, fourth), (7, say(60)), (8, fourth + " x"), (9, ""), (9, ""), (None, None), (None, say(60)), (None, other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(((x.doc_id is None, x.doc_id or 0, x.component_id or 0, x.kept) for x in bottomk.digest(df).collect()))
    assert [f[2] for f in found if not f[0]] == [1, 7, 7, 7, 9, 9]
    assert sorted((f[2], f[3]) for f in found if f[0]) == [(0, True)] * 5 + [(1, False)]
    kept = sorted((x.doc_id or 0, x.text or "") for x in bottomk.one_of_each(df).collect())
    assert kept == sorted([(1, base), (0, other), (0, third), (7, fourth), (7, rows[5][1]), (9, ""), (0, ""), (0, rows[10][1])])


def test_leaks_of_items_without_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(None, " ".join(text.split()[5:15])), (None, None), (3, "word1 word2")], "item_id bigint, text string")
    rows = [(1, text), (1, "word5 word6"), (None, "Word1 WORD2 x"), (None, None), (None, "word1 word2"), (None, "word1 word2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.digest(docs, items).collect())
    assert got == sorted([(1, 30, 12, 1, True), (1, 2, 0, 0, False), (0, 3, 2, 1, True), (0, 0, 0, 0, False), (0, 2, 2, 1, True), (0, 2, 2, 1, True)])
    assert [r.n_words for r in decontamination.digest(decontamination.clean(docs, items), items).orderBy("n_words").collect()] == [0, 2]


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.03 * r.standard_normal(16)).tolist(), int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[1][1], rows[1][2]), (202, [0.0] * 16, 1), (203, None, 1), (204, [float("nan")] * 16, 1), (205, [1.0, None], 1), (206, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    good = [(i, np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: set() for i, _, _ in rows}
    for i, v, y in good:
        near[i] = {j for j, w, z in good if j != i and y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98}
    got = {r.vec_id: r for r in projections.linked_vectors(vectors).collect()}
    assert {i: got[i].n_links for i in near} == {i: len(n) for i, n in near.items()}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_personal(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = {r.doc_id: r for r in personal.digest(docs).collect()}
    for i, text in enumerate(_texts()):
        said = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text or ""):
                d = re.sub("[^0-9]", "", m.group())
                good = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                said += [f"{kind}:{m.start()}:{m.end()}"] if good else []
        assert got[i].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()


def test_disclosing_terms(spark):
    rows = [(i, f"Zorblax wrote to a{i % 2}@x.org on day {chr(97 + i) * 3}\nplain words here") for i in range(12)] + [(i, f"many plain words here and there on day one of {i}") for i in range(20, 60)]
    found = {r.doc_id: r.spans for r in personal.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all("term" not in found[i] for i in range(20, 60))
    only = [(i, t.replace("a1@", "a0@")) for i, t in rows]
    df = spark.createDataFrame(only, "doc_id bigint, text string")
    assert all("term:0:7" in r.spans for r in personal.digest(df).where("doc_id < 20").collect())
    assert personal.sanitised(df).where("doc_id = 0").first().text.startswith("[TERM]")


def test_disclosure_scores(spark):
    """Against a plain count over different lines, which copies of whole documents do not change."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 4))) for _ in range(n))
    lines_ = [say(4) for _ in range(300)]
    for k in range(40):
        lines_.append(f"{say(2)} Name{'abcdefgh'[min(k % 9, 7)]} {say(1)} u{k % 9}@x.org" if k < 36 else f"Once {say(1)} v{k}@x.org")
    texts = ["\n".join(lines_[i : i + 5]) for i in range(0, len(lines_), 5)]
    terms = lambda line: set(re.findall(r"[^\W\d_]{3,}", re.sub(r"[uv]\d+@x\.org", " ", line).lower()))
    values, n = [(line, m.group()) for line in set(lines_) for m in re.finditer(r"[uv]\d+@x\.org", line)], len(set(lines_))
    want = set()
    for value in {v for _, v in values}:
        own = {line for line, v in values if v == value}
        for term in set().union(*map(terms, own)):
            f = sum(term in set(re.findall(r"[^\W\d_]{3,}", line.lower())) for line in set(lines_))
            j, g, z = sum(term in terms(line) for line in own), len(own), personal.ERRORS**2
            p = j / f
            q = (p + z / (2 * f) - personal.ERRORS * np.sqrt(p * (1 - p) / f + z / (4 * f * f))) / (1 + z / f)
            if np.log(n * q / g) >= personal.DISCLOSED * np.log(n / g):
                want.add((f"email:{value}", term))
    assert 3 < len(want)
    for copies in (1, 5):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "doc_id bigint, text string")
        keyed = personal.keyed_texts(docs)
        assert {tuple(x) for x in personal.disclosing_terms(personal.base_spans(keyed), keyed).collect()} == want


def test_texts_are_read_as_often_for_many_terms(spark):
    name = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))

    def reads(terms):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = [(i, i, f"a{i}@x.org " + " ".join(map(name, range(i * terms, (i + 1) * terms)))) for i in range(60)]
        texts = spark.createDataFrame(rows, "id bigint, th bigint, text string")
        base = personal.written(personal.base_spans(texts), "test-base")
        pairs = personal.disclosing_terms(base, texts.mapInArrow(counted, texts.schema), disclosed=0.0).distinct().count()
        return seen.value, pairs

    few, many = reads(2), reads(900)
    assert few[1] == 120 and many[1] == 54_000 and few[0] == many[0]


@pytest.mark.parametrize("min_chars", [20, 5])
def test_lines(spark, min_chars):
    """Longer lines by their shingles, shorter ones where they repeat exactly; blank ones stay."""
    r = random.Random(2)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    base = [line() for _ in range(6)]
    texts = ["\n".join(base), base[0].upper() + "\nshort\nshort\n\t", "Short \ntiny\nshor\n TINY", "\n".join([line(), base[1][:-1] + "z", base[2]]), "", None, "\n\n", base[3] + "\n" + base[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def shingles(x):
        x = lines.normal(x)
        return {x[i : i + 5] for i in range(len(x) - 4)}

    kept, short, want = [], set(), {}
    for i, t in enumerate(texts):
        out = []
        for x in (t or "").split("\n"):
            s = shingles(x)
            if not lines.normal(x):
                pass
            elif len(lines.normal(x)) < min_chars:
                if lines.normal(x) in short:
                    continue
                short.add(lines.normal(x))
            else:
                if any(len(s & k) >= lines.SIMILARITY * len(s | k) for k in kept):
                    kept.append(s)
                    continue
                kept.append(s)
            out.append(x)
        want[i] = "\n".join(out)
    got = {r.doc_id: r.kept_sha256 for r in lines.digest(docs, min_chars).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


@pytest.mark.parametrize("chunk", [128, 3])
def test_families_of_lines(spark, monkeypatch, chunk):
    """Chains of similar lines, short and long, in buckets of many members: all links are found."""
    monkeypatch.setattr(lines, "CHUNK", chunk)
    r, rows = random.Random(12), []
    for size in (40, 90, 180):
        for _ in range(4):
            base = [r.choice("abcdefghijklmnop ") for _ in range(size)]
            for _ in range(11):
                copy = list(base)
                for i in r.sample(range(size), r.randint(0, size // 22)):
                    copy[i] = r.choice("qrstuv")
                rows.append("".join(copy).strip() + "x")
                if r.random() < 0.4:
                    base = copy
    r.shuffle(rows)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in map(lines.normal, rows)]
    up = list(range(len(rows)))
    top = lambda x: x if up[x] == x else top(up[x])
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    want = {i for i in range(len(rows)) if top(i) != i}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    got = {x.id for x in lines.repeated_lines(docs).collect()}
    # A pair at the threshold meets in a band in 99.8 of 100 cases; no other line may be missed or lost.
    assert got <= want and len(want - got) <= 1 and len(want) > 60


def test_lines_on_both_sides_of_long(spark):
    """A line that counts as short meets one that counts as long, also where the long one repeats itself."""
    r, pairs = random.Random(21), []
    for extra in (4, 8, 16, 30):
        a = "".join(r.choice("abcdefghijklmnop") for _ in range(lines.LONG + lines.SHINGLE - 3))
        pairs += [(a, a + "".join(r.choice("qrstuv") for _ in range(extra)))]
    word = "".join(r.choice("abcdefghijklmnop") for _ in range(30))
    pairs.append((word * 2, word * 40))
    counts = [[len(x) - lines.SHINGLE + 1 >= lines.LONG for x in pair] for pair in pairs]
    assert counts == [[False, True]] * len(pairs)
    met = lines.band_keys([a for a, _ in pairs]) == lines.band_keys([b for _, b in pairs])
    assert met.any(axis=1).filled(False).all()
    far = "".join(r.choice("abcdefghijklmnop") for _ in range(400))
    assert lines.band_keys([far]).count() == lines.BANDS
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for pair in pairs for x in pair)], "doc_id bigint, text string")
    assert {x.id for x in lines.repeated_lines(docs).collect()} == set(range(1, 2 * len(pairs), 2))


def test_lines_from_three_quarters_on(spark):
    r, pairs = random.Random(8), []
    shingles = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    while len(pairs) < 60:
        a = "".join(r.choice("abcdefghijklmnop") for _ in range(90))
        b = list(a)
        for i in r.sample(range(90), r.randint(2, 4)):
            b[i] = "z"
        p, q = shingles(a), shingles("".join(b))
        if 0.75 <= len(p & q) / len(p | q) < 0.85:
            pairs.append((a, "".join(b)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for pair in pairs for x in pair)], "doc_id bigint, text string")
    assert {r.id for r in lines.repeated_lines(docs).collect()} == set(range(1, 120, 2))
    met = lines.band_keys([a for a, _ in pairs]) == lines.band_keys([b for _, b in pairs])
    assert met.any(axis=1).all()


def test_vectors_of_a_dense_label(spark):
    r, d = np.random.default_rng(4), 128
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    some = unit(unit(r.standard_normal(d)) + 0.204 * unit(r.standard_normal((500, d))))
    x = np.concatenate([some, unit(some[:150] + 0.19 * unit(r.standard_normal((150, d))))])
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert near[np.arange(150), np.arange(500, 650)].all()
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.linked_vectors(docs).collect()}
    component = np.arange(len(x))
    while (least := np.where(near, component[None], component[:, None]).min(axis=1)).tolist() != component.tolist():
        component = np.minimum(component, least)
    assert got == {i: (int(near[i].sum()), int(component[i])) for i in range(len(x))}


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        s = by.setdefault(r.source, [r.target, r.source_size, 0])
        s[2] += r.taken
    # Null stands last: a, b, c and null weigh 1, 2, 3, 1.
    size, weight, capped = {k: v[1] for k, v in by.items()}, {"a": 1, "b": 2, "c": 3, None: 1}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[k] for k in capped)) / sum(weight[k] for k in size if k not in capped)
        if not (more := {k for k in size if k not in capped and level * weight[k] > 3 * size[k]}):
            break
        capped |= more
    for k, (target, _, taken) in by.items():
        assert target == pytest.approx(3 * size[k] if k in capped else level * weight[k]) and abs(taken - target) <= 20


def test_subset_fit():
    lengths, counts = np.array([7, 11, 5000, 90000]), np.array([3, 2, 4, 1])
    reachable = {a * 7 + b * 11 + c * 5000 + d * 90000 for a in range(4) for b in range(3) for c in range(5) for d in range(2)}
    for budget in (0, 1, 25, 43, 5018, 20000, 110043, 10**9):
        take = mixing.subset_fit(lengths, counts, min(budget, int((lengths * counts).sum())))
        assert (take <= counts).all() and int((take * lengths).sum()) in reachable and int((take * lengths).sum()) <= budget


def test_urls(spark):
    html = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [
        (1, "http://A.example.net/en/1", html("https://good.info/x", "/own")), (2, "http://x.net/", None), (3, "https://good.info/p?q#f", ""),
        (4, "http://bad.info", html("//x.net/y")), (5, None, None), (6, "no scheme", ""), (7, "http://example.com/de/x", ""), (8, "http://o.org/fr/", ""),
        (9, "http://x.net", ""), (10, "http://far.info/?://z", ""),
    ]
    got = {r.page_id: r for r in url_trust.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    said = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert said[1] == ("example.net/en/", "allow") and said[2] == ("net/", "block") and said[3] == (None, "allow") and said[4] == (None, "block")
    assert said[5] == said[6] == said[10] == (None, "allow") and said[7] == ("example.com/de/", "block") and said[8] == ("org/fr/", "allow")
    assert (got[1].host, got[1].path, got[3].path, got[9].rule) == ("a.example.net", "/en/1", "/p", None) and got[9].verdict == "block"
    assert got[3].trust > 0 and got[4].distrust > 0


def test_link_ranks(spark):
    """Against a dense walk in numpy; a blocked host's neighbours stay blocked beside a large crowd."""
    r = random.Random(4)
    hosts = [f"h{i}.info" for i in range(25)] + ["a.example.net", "b.net", "c.net"]
    to = {h: [r.choice(hosts) for _ in range(r.randint(0, 4))] for h in hosts}
    page = lambda i, h: (i, f"http://{h}/en/", "".join(f'<a href="http://{t}/">' for t in to[h]))
    rows = [page(i, h) for i, h in enumerate(hosts)]
    got = {x.host: (x.trust, x.distrust) for x in url_trust.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    links = np.zeros((n, n))
    for h in hosts:
        for t in to[h]:
            links[at[h], at[t]] += t != h
    for k, (steps, seeds) in enumerate(((links, ["a.example.net"]), (links.T, ["b.net", "c.net"]))):
        ends = steps.sum(axis=1) == 0
        walk = np.where(ends[:, None], np.eye(n), steps / np.maximum(steps.sum(axis=1, keepdims=True), 1))
        start = np.isin(hosts, seeds).astype(float)
        rank = np.linalg.solve(np.eye(n) - url_trust.DAMPING * walk.T, (1 - url_trust.DAMPING) * start)
        assert np.allclose([got[h][k] for h in hosts], rank, atol=2 * url_trust.UNDECIDED)
    bad = [(0, "http://b.net/", "")] + [(i, f"http://l{i}.info/", '<a href="http://b.net/">') for i in range(1, 201)]
    crowd = [(1000 + i, f"http://x{i}.net/", "") for i in range(3000)]
    for rows in (bad, bad + crowd):
        said = url_trust.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string")).where("page_id < 1000")
        assert {x.verdict for x in said.collect()} == {"block"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id bigint, text string")
    for df in (phrases.digest(none), suffixes.digest(none), decontamination.digest(none, items), bottomk.digest(none), personal.digest(none), lines.digest(none), mixing.mix(none)):
        assert df.count() == 0
    assert projections.linked_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert url_trust.judged(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_network_gradients():
    import pyarrow as pa

    from titrant.llm import kernels

    net = toxicity.Network.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, offsets = kernels.text_bytes(pa.array(["you idiot go away now", "kind words here"]))
    t = toxicity.tokens(data, offsets)
    start, length, _ = toxicity.windows(t.first)
    ids, mask = toxicity.batch_ids(t, start, length)

    def loss():
        return net.forward(net.project(net.inputs(t).astype(np.float64)), ids, mask).sum()

    x, keep = net.inputs(t), {}
    net.forward(net.project(x), ids, mask, keep)
    grads = net.gradients(t, x, ids, mask, keep, np.ones(len(start)))
    for name in ("rec_f", "in_b", "att", "out", "bias_f"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-2
        up = loss()
        net.p[name][at] = before - 1e-2
        down = loss()
        net.p[name][at] = before
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.08, abs=1e-3)


def test_toxicity(spark, docs):
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(i, say(r.randint(5, 60)) + (" you worthless clown " if i % 4 == 0 else " ") + say(r.randint(5, 60))) for i in range(400)]
    texts = spark.createDataFrame(rows + [(1000, ""), (1001, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000, None)], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in toxicity.digest(texts, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.9
    assert got[1000].score == got[1001].score == 0.0
    assert all(x.score == 0 for x in toxicity.digest(texts, labels.limit(0)).collect())


def test_scoring_is_small():
    """A batch of texts is scored in parts, from Arrow's own bytes."""
    r = random.Random(3)
    texts = pa.array([" ".join(f"w{r.randint(0, 99_999)}" for _ in range(280)) for _ in range(3000)] + [None, ""])
    net = toxicity.Network.new()
    want = net.text_logits(*toxicity.kernels.text_bytes(texts))
    tracemalloc.start()
    found = toxicity.scores(texts, net)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    assert np.allclose(found, np.where(np.isfinite(want), toxicity._sigmoid(want), 0), atol=1e-6)


def test_collocation_scan_is_small():
    """Arrays of a scan follow a slab of bounded size and not the batch."""
    import tracemalloc

    import pyarrow as pa

    from titrant.llm import collocations

    r = random.Random(1)
    texts = [" ".join(str(r.randrange(10_000)) for _ in range(25_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(texts)], ["lang", "text"])
    sum(x.num_rows for x in collocations._pairs(batch))
    tracemalloc.start()
    total = sum(sum(x["n"].to_pylist()) for x in collocations._pairs(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 40 * (25_000 - 1) and peak < 50e6


def test_suffix_buckets_are_arrow():
    """A bucket in several parts, one of them a slice, against the strings written out."""
    import pyarrow as pa

    r = random.Random(4)
    around = [bytes(r.choice(b"ab") for _ in range(2)) * 12 + b"x" + bytes(50) for _ in range(40)]
    ids = [i % 9 for i in range(40)]
    t = pa.table({
        "id": pa.array(ids, pa.int64()), "th": pa.array([i * 7 for i in ids], pa.int64()), "place": pa.array(range(100, 140), pa.int64()),
        "near": pa.array([0] * 40, pa.int64()), "far": pa.array([3] * 40, pa.int64()), "around": pa.array(around, pa.binary()),
    })
    whole = pa.concat_tables([t.slice(0, 11), t.slice(11)])
    want, strings = {}, {}
    for i in range(40):
        for back in range(4):
            strings.setdefault(around[i][25 - back : 75 - back], []).append((ids[i], 100 + i - back))
    for found in strings.values():
        for i, start in found:
            if i > min(found)[0]:
                want.setdefault(i, set()).add(start)
    got = suffixes._bucket(whole).to_pylist()
    assert {x["id"]: set(x["start"]) for x in got} == want and all(x["th"] == 7 * x["id"] for x in got)
    assert suffixes._bucket(t.slice(0, 1)).num_rows == 0


def test_overlaps():
    from titrant.llm import kernels

    r = random.Random(3)
    sets = [{r.randrange(60) for _ in range(r.randrange(30))} for _ in range(17)]
    flat = [(v, i) for i, x in enumerate(sets) for v in [*x, *list(x)[:2]]]
    values, owner = np.array([f[0] for f in flat], np.uint64), np.array([f[1] for f in flat])
    for columns in (4096, 7):
        sizes, both = kernels.overlaps(values, owner, 6, 11, columns)
        assert sizes.tolist() == [len(x) for x in sets]
        assert both.tolist() == [[len(x & y) for y in sets[6:]] for x in sets[:6]]


def test_main_component_is_the_largest(spark, monkeypatch):
    """A first member that links with nothing leaves only itself outside of its group's main component."""
    r = random.Random(8)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    base, opened, written = say(100), [], bottomk.written

    def seen(df, label):
        out = written(df, label)
        if label == "near-open":
            opened.extend((x.a, x.m, x.k) for x in out.collect())
        return out

    monkeypatch.setattr(bottomk, "written", seen)
    texts = [" ".join([*base, *say(4 * (i % 3 == 0) + 40 * (i < 3))]) for i in range(30)]
    found = bottomk.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert len({x.component_id for x in found.collect()}) == 4
    assert opened and all(2 * k < m for _, m, k in opened)


def test_rows_of_open_line_groups(spark):
    """Members move once while a group fits one comparison, however many components it has."""
    rows = [(1, c, c, 1) for c in range(1, 601)] + [(2, c, c, 2) for c in range(2, 40)]
    members = spark.createDataFrame(rows, "a bigint, c bigint, component bigint, main bigint")
    assert lines._chunked(members, lines.CHUNK).count() == 600 + 599 + 38 + 37
    assert lines._chunked(members, 100).count() == 600 * 6 + 599 * 6 + 38 + 37


@pytest.mark.parametrize(("meeting", "told", "batch"), [(256, 3, 400), (20, 2, 7), (20, 2, 90), (5, 1, 33)])
def test_buckets_lose_no_pair(monkeypatch, meeting, told, batch):
    """Every pair of a bucket that sketches allow is a pair or lies in one group, however the rows are
    dealt into batches; rows grow with the members, and buckets of unlike lines leave none."""
    monkeypatch.setattr(lines, "MEETING", meeting)
    monkeypatch.setattr(lines, "TOLD", told)
    monkeypatch.setattr(lines, "PAIRS", 50)
    r = np.random.default_rng(meeting + batch)
    rows, c = [], 0
    for key, (families, size) in enumerate([(12, 1), (1, 40), (3, 9), (1, 2), (4, 1), (2, 60), (1, 1), (1, meeting), (1, meeting + 1)]):
        for base in r.integers(0, 2**63, (families, 4)):
            for _ in range(size):
                c += 1
                rows.append((key, c, 60, *(base ^ (1 << r.integers(0, 63, 4)))))
    rows = sorted((k, int(name), n, *s) for (k, _, n, *s), name in zip(rows, r.permutation(c), strict=True))
    names = ["key", "c", "n", *lines._SKETCH]
    table = pa.table([pa.array([x[i] for x in rows], pa.int32() if i == 2 else pa.int64()) for i in range(7)], names)
    out = [x for y in lines._bucketed(0.75)(iter(table.to_batches(batch))) for x in zip(*y.to_pydict().values(), strict=True)]
    pairs, groups = {(a, b) for a, b, pair in out if pair}, {(a, b) for a, b, pair in out if not pair}
    of = {}
    for a, b in groups:
        of.setdefault(b, set()).add(a)
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[0] == y[0] and sum((p ^ q).bit_count() for p, q in zip(x[3:], y[3:], strict=True)) <= 120 / 7:
                assert (x[1], y[1]) in pairs or of.get(x[1], set()) & of.get(y[1], set())
    assert all((a, a) in groups for a, _ in groups)
    assert len(out) == len(set(out)) <= len(rows) * (told + 1)
    assert not {x[1] for x in rows if x[0] in (0, 4)} & {b for _, b, _ in out} or meeting < 12


def test_lines_leave_texts_without_python(spark):
    """Whole texts stay in Spark where removed lines leave them; blank lines and ends keep their places."""
    texts = ["one\ntwo\n\n three", "\nTwo\nfour\n", "one\nTHREE", "\n\none\n\n", "five", "five\n", None, "", "six\r\nsix\n\t\n six", "\n".join(["seven"] * 3000 + ["eight"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = lines.cleaned(docs)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    seen, want = set(), {}
    for i, text in enumerate(texts):
        out = []
        for line in (text or "").split("\n"):
            if not (short := lines.normal(line)) or short not in seen:
                out.append(line)
            seen.add(short)
        want[i] = (text if text is None else "\n".join(out), (text or "").count("\n") + 1 - len(out))
    assert {r.id: (r.cleaned, r.n_removed) for r in found.collect()} == want


def test_texts_travel_in_bounded_batches(spark):
    """Arrow batches of a written table keep to their bytes, and the setting goes with the job."""
    from pyspark.sql import functions as F

    from titrant.llm import shared

    docs = spark.range(400).select(F.repeat(F.lit("x"), 10_000).alias("text")).coalesce(1)
    sizes = shared.by_batch(docs, lambda b: iter([pa.RecordBatch.from_pydict({"n": [b.num_rows]})]), "n long")
    before = spark.conf.get(shared._BATCH)
    rows = [r.n for r in shared.written(sizes, "test", 100_000).collect()]
    assert sum(rows) == 400 and max(rows) <= 12 and spark.conf.get(shared._BATCH) == before
