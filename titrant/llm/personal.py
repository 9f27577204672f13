"""Personal data: patterns, and terms that give protected values away, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.llm.shared import back_to_id, keyed_texts, row_id, written

#: The patterns of the contract, written so that no text makes them slow or deep: quantifiers that
#: never have to give back are possessive, and a run of characters is only tried from its start or
#: from where the match before it ended.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_TERM = r"\p{L}{3,}"
#: A term discloses a value if knowing the term tells this share of the value's information, even
#: with the least probability that so many standard errors leave open.
DISCLOSED, ERRORS = 0.8, 1.96


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, keep) -> Column:
    """(s, e, v) of each match that `keep` accepts, in order, counted in characters.

    The text between matches and the matches themselves add up to the positions; only accepted
    matches are gathered.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["v"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))
        return F.struct(e.alias("at"), F.when(keep(x["v"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("v")), lambda x: x["v"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def base_spans(texts: DataFrame) -> DataFrame:
    """(id, th, email, ip, card, phone, text): spans per kind; the text only where there are any."""
    must = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = {}
    for kind, pattern in PATTERNS.items():
        spans = _spans(text, pattern, lambda v, k=kind: _valid(k, v))
        found[kind] = F.when(F.contains(text, F.lit(must[kind])), spans).otherwise(none) if must[kind] else spans
    some = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    return texts.withColumns(found).select("id", "th", *PATTERNS, F.when(some, F.col("text")).alias("text"))


def _entity(kind: str, value: Column) -> Column:
    same = F.lower(value) if kind == "email" else F.regexp_replace(value, "[ ().-]", "") if kind in ("card", "phone") else value
    return F.concat(F.lit(f"{kind}:"), same)


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda x: _entity(kind, x["v"]))


def least_share(j: Column, f: Column, errors: float = ERRORS) -> Column:
    """The least probability that j of f cases leave open, by Wilson's interval."""
    p, z = j / f, errors * errors
    return (p + z / (2 * f) - errors * F.sqrt(p * (1 - p) / f + z / (4 * f * f))) / (1 + z / f)


def disclosing_terms(base: DataFrame, texts: DataFrame, disclosed: float = DISCLOSED, errors: float = ERRORS) -> DataFrame:
    """(entity, term) where the term gives the protected value away.

    Contexts are different lines, so copies change nothing. With N lines, a term in f of them, a
    value in g, and both in j, the term names the value with probability j / f, or at least q, the
    lower end of that share's confidence interval. It then tells log(N q / g) of the log(N / g) that
    it would take to name the value, and discloses it where that share reaches `disclosed`. Few
    cases widen the interval instead of being left out. All numbers are exact, and texts are read
    as often for many terms as for few.
    """
    lines = (
        base.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
        .select(F.xxhash64("line").alias("lh"), F.col("line").alias("text")).dropDuplicates(["lh"])
    )
    kinds = {k: _spans(F.col("text"), p, lambda v, k=k: _valid(k, v)) for k, p in PATTERNS.items()}
    lined = lines.withColumns(kinds)
    # Terms outside the values themselves.
    bare = F.col("text")
    for pattern in PATTERNS.values():
        bare = F.regexp_replace(bare, pattern, " ")
    entities = F.flatten(F.array(*[_entities(k) for k in PATTERNS]))
    told = written(
        lined.select("lh", F.array_distinct(entities).alias("entities"), F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(_TERM), F.lit(0))).alias("terms")).where("size(entities) > 0"),
        "personal-lines",
    )
    values = told.select("lh", F.explode("entities").alias("entity"), "terms")
    often = values.groupBy("entity").agg(F.count(F.lit(1)).alias("g"))
    joint = written(
        values.join(often, "entity").select("entity", "g", F.explode("terms").alias("term"))
        .groupBy("entity", "g", "term").agg(F.count(F.lit(1)).alias("j")),
        "personal-pairs",
    )
    if joint.isEmpty():
        return joint.select("entity", "term")
    every = texts.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("lh"), "line")
    total = float(every.select("lh").distinct().count())
    # One line of each kind is left, so a term's lines add up inside tasks to one number per term.
    counted = (
        every.dropDuplicates(["lh"]).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(_TERM), F.lit(0)))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    )
    f = F.greatest("f", "j").cast("double")
    tells = F.log(F.lit(total) * least_share(F.col("j"), f, errors) / F.col("g"))
    telling = joint.join(counted, "term").where(F.col("g") < total).where(tells >= disclosed * F.log(F.lit(total) / F.col("g")))
    return written(telling.select("entity", "term"), "personal-telling")


def spans(docs: DataFrame) -> DataFrame:
    """(id, th, email, ip, card, phone, term) for every row of `docs`: spans per kind.

    `term` holds the terms that disclose a value standing in the same text, wherever they occur in
    it outside base spans. Null and empty texts have none; repeated rows share their spans, a
    missing id sorts last, an empty table gives no rows, other columns are not read.
    """
    texts = keyed_texts(docs)
    base = written(base_spans(texts), "personal-base")
    telling = disclosing_terms(base, texts)
    held = F.array_distinct(F.flatten(F.array(*[_entities(k) for k in PATTERNS])))
    terms = (
        base.where("text is not null").select("id", "th", F.explode(held).alias("entity"))
        .join(telling, "entity").groupBy("id", "th").agg(F.collect_set("term").alias("terms"))
    )
    flat = F.flatten(F.array(*[F.col(k) for k in PATTERNS]))
    found = (
        base.where("text is not null").join(terms, ["id", "th"])
        .withColumn("all", flat)
        .select("id", "th", "all", _spans(F.col("text"), r"\p{L}{3,}", lambda v: F.array_contains(F.col("terms"), F.lower(v))).alias("t"))
        .select("id", "th", F.filter("t", lambda x: ~F.exists("all", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))).alias("term"))
        .dropDuplicates(["id", "th"])
    )
    return base.drop("text").join(found, ["id", "th"], "left").withColumn(
        "term", F.coalesce("term", F.array().cast("array<struct<s:int,e:int,v:string>>"))
    )


def digest(docs: DataFrame) -> DataFrame:
    said = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat_ws(",", F.flatten(F.array(*[said(k) for k in PATTERNS])))
    every = F.concat_ws(",", F.flatten(F.array(*[said(k) for k in (*PATTERNS, "term")])))
    return spans(docs).select(
        back_to_id("id").alias("doc_id"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("term").cast("bigint").alias("n_term"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with every span of `text` replaced by its kind in brackets, a term by
    [TERM]; where spans overlap, the one that starts first (then the longer) is replaced."""
    found = spans(docs).dropDuplicates(["id", "th"])

    def mark(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(f"[{kind.upper()}]").alias("by")))

    marks = F.flatten(F.array(*[mark(k) for k in (*PATTERNS, "term")]))
    found = found.select("id", "th", F.sort_array(marks).alias("marks"))
    whole = docs.select(F.struct("*").alias("row"), row_id().alias("id"), F.xxhash64("text").alias("th")).join(found, ["id", "th"], "left")
    text = F.col("row.text")
    step = lambda a, m: F.when(
        m["s"] >= a["at"],
        F.struct((-m["e"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, m["s"] - a["at"]), m["by"]).alias("out")),
    ).otherwise(a)
    done = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.size("marks") > 0, done).otherwise(text)
    return whole.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
