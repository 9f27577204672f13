"""Stable names, seeds and small text decoders."""

from pyspark.sql import Column, functions as F

from titrant.constants import ALPHABET


def _filename_safe(number: Column) -> Column:
    return F.replace(
        F.replace(F.replace(number, F.lit("+"), F.lit("p")), F.lit("-"), F.lit("m")),
        F.lit("."),
        F.lit("_"),
    )


def dose_tag(beta: Column) -> Column:
    """+1.5 becomes p1_5."""
    return _filename_safe(F.format_string("%+.1f", beta))


def job_key(entry: Column, chain: Column, beta: Column, replicate: Column) -> Column:
    return F.concat(
        entry, F.lit("_"), chain, F.lit("_beta"), _filename_safe(F.format_string("%+.4f", beta)),
        F.lit("_rep"), replicate.cast("string"),
    )


def row_seed(global_seed: int, entry: Column, beta: Column, replicate: Column) -> Column:
    """First four bytes of a digest, so adding rows never shifts another row's seed."""
    text = F.concat_ws(
        "|", F.lit(str(global_seed)), entry.cast("string"), F.format_string("%.6f", beta),
        replicate.cast("string"),
    )
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def residue_label(chain: Column, seqid: Column, icode: Column) -> Column:
    return F.concat(chain, seqid.cast("string"), F.trim(icode))


def residue_id_text(chain: Column, seqid: Column, icode: Column) -> Column:
    return F.concat_ws(":", chain, seqid.cast("string"), F.trim(icode))


def decode_indices(indices: Column) -> Column:
    """Letters for an index array; null when any code lies outside the alphabet."""
    bad = F.exists(indices, lambda i: (i < 0) | (i >= len(ALPHABET)))
    letters = F.transform(indices, lambda i: F.substr(F.lit(ALPHABET), i + 1, F.lit(1)))
    return F.when(~bad, F.array_join(letters, ""))
