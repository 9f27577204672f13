"""URL verdicts by rules, and by trust and distrust that spread over links between hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from titrant.llm.shared import removed, written

#: (rule, host, path, verdict): the host and its subdomains, where the path starts with the rule's.
RULES = (
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
)
#: A walk goes on with this probability. After k rounds DAMPING**k of every seed's mass is still on
#: its way, whatever the graph, so the rounds follow from the share that may be.
DAMPING, UNDECIDED = 0.85, 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute address in an attribute, up to the end of its host.
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Between the first "://" and the next of / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """Adds `rule` and `ruled` (its verdict) from the longest rule that fits, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, host, path, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Counted per pair of hosts first, so pages of a
    host with very many pages meet before anything moves."""
    found = (
        pages.where("host <> ''")
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
        .select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst"))
        .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )
    return written(found, "url-links")


def propagate(edges: DataFrame, seeds: DataFrame, undecided: float = UNDECIDED) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from `seeds` (kind, host, mass).

    Trust starts at trusted seeds and follows links; distrust starts at blocked seeds and goes
    against them, to who links there. Both walks are one table of directed, weighted steps, so one
    join and one sum per round serve both. A walk at a host without steps starts anew there, so no
    mass is lost and the ranks of a kind add up to its seeds' mass. Ranks are linear in the seeds:
    what one seed gives does not depend on how many others there are. Rounds go on until at most
    `undecided` of each seed's mass has not settled. Every fourth round is written, which cuts
    lineage and survives lost executors.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), (F.col("n") / F.col("all")).alias("w"))
    against = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), (F.col("n") / F.col("all")).alias("w"))
    steps = written(forward.unionByName(against), "url-steps")
    start = written(seeds.select("kind", F.col("host").alias("u"), F.col("mass").cast("double").alias("mass")), "url-seeds")
    rank, old = start.select("kind", "u", F.col("mass").alias("r")), None
    rounds = 0 if steps.isEmpty() else math.ceil(math.log(undecided) / math.log(DAMPING))
    for i in range(1, rounds + 1):
        moved = rank.join(steps, ["kind", "u"], "left").select(
            "kind", F.coalesce("v", "u").alias("u"), (F.col("r") * F.coalesce("w", F.lit(1.0)) * DAMPING).alias("r"))
        rank = (
            moved.unionByName(start.select("kind", "u", (F.col("mass") * (1 - DAMPING)).alias("r")))
            .groupBy("kind", "u").agg(F.sum("r").alias("r"))
        )
        if i % 4 == 0 or i == rounds:
            rank = written(rank, "url-rank")
            if old is not None:
                removed(old)
            old = rank
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(k)
    return rank.groupBy(F.col("u").alias("host")).agg(pick("trust"), pick("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str, str]] = RULES, margin: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of `pages`.

    Seeds are hosts by their pages that a rule allows or blocks, with one unit of mass per page. A
    page without a rule is blocked if its host's distrust exceeds `margin` times its trust; hosts
    out of reach of any seed are allowed. Neither changes with pages elsewhere, however many.

    A null url, or one without "://", has an empty host and path, no rule, and is allowed. Null or
    empty html has no links. Repeated pages each get their row; an empty table gives none; other
    columns are not read.
    """
    rows = pages.select(
        "page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    ruled = with_rule(rows, rules)
    seeds = (
        ruled.where("host <> '' and rule is not null")
        .groupBy("host", F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"))
        .agg(F.count(F.lit(1)).alias("mass"))
    )
    spread = propagate(links(rows), seeds)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > margin * trust, "block").otherwise("allow")
    return ruled.drop("html").join(spread, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
