"""One query per operator, each over its whole table."""

import public_tokenizers

from titrant.llm import (
    bottomk, collocations, decontamination, importance, lines, mixing, personal, phrases, prefix_bpe, projections, sql, suffixes, toxicity, url_trust,
)
from titrant.llm.shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op4_set_join_decontamination", sql.LEAKS)
def op4(spark, sf_dir):
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_bottomk_near_duplicates", sql.NEAR)
def op8(spark, sf_dir):
    return bottomk.digest(table(spark, sf_dir, "documents"))


@query("op9_budget_mix")
def op9(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_fuzzy_lines")
def op10(spark, sf_dir):
    return lines.digest(table(spark, sf_dir, "documents"))


@query("op3_recurrent_toxicity")
def op3(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_link_trust_urls")
def op1(spark, sf_dir):
    return url_trust.judged(table(spark, sf_dir, "pages"))


@query("op7_sorted_projections", sql.VECTORS)
def op7(spark, sf_dir):
    return projections.linked_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_phrase_automata", sql.PHRASES)
def op2(spark, sf_dir):
    return phrases.digest(table(spark, sf_dir, "documents"))


@query("op6_disclosing_terms")
def op6(spark, sf_dir):
    return personal.digest(table(spark, sf_dir, "documents"))


@query("op5_sorted_suffixes", sql.SUFFIXES)
def op5(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling", sql.DRAWN)
def op11(spark, sf_dir):
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_prefix_bpe")
def op12(spark, sf_dir):
    return prefix_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_rollup_collocations", sql.COLLOCATIONS)
def op13(spark, sf_dir):
    return collocations.mined(table(spark, sf_dir, "documents"))
