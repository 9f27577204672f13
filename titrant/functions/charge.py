"""Charge of a sequence or of one residue, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from titrant import constants as K
from titrant.params import ChargeParams


def count_letters(seq: Column, letters: str) -> Column:
    """How many characters of `seq` are in `letters`; stays in generated code, no explode. A letter is
    searched for as bytes, which `translate` would look up one character at a time."""
    size = F.octet_length if letters.isascii() else F.length
    return sum((size(seq) - size(F.replace(seq, F.lit(a), F.lit(""))) for a in dict.fromkeys(letters)), F.lit(0))


def residue_charge_simple(aa: Column) -> Column:
    return (
        F.when(aa.isin(*K.SIMPLE_POSITIVE), 1).when(aa.isin(*K.SIMPLE_NEGATIVE), -1).otherwise(0)
    )


def net_charge_simple(seq: Column) -> Column:
    return count_letters(seq, K.SIMPLE_POSITIVE) - count_letters(seq, K.SIMPLE_NEGATIVE)


def _gain(ph: float, pka: float) -> float:
    return 1.0 / (1.0 + 10.0 ** (ph - pka))


def _loss(ph: float, pka: float) -> float:
    return -1.0 / (1.0 + 10.0 ** (pka - ph))


def letter_charges(p: ChargeParams) -> dict[str, float]:
    """Side-chain charge of each titrating letter at the given pH."""
    pka = K.PKA[p.pka_set]
    charges = {a: _gain(p.ph, pka[a]) for a in K.TITRATING_POSITIVE}
    charges |= {
        a: _loss(p.ph, pka[a]) for a in K.TITRATING_NEGATIVE if p.cys_tyr or a not in ("C", "Y")
    }
    return charges


def terminal_charges(p: ChargeParams) -> tuple[float, float]:
    if not p.termini:
        return 0.0, 0.0
    pka = K.PKA[p.pka_set]
    return _gain(p.ph, pka["Nterm"]), _loss(p.ph, pka["Cterm"])


def side_chain_charge(aa: Column, p: ChargeParams = ChargeParams()) -> Column:
    out = None
    for letter, charge in letter_charges(p).items():
        out = F.when(aa == letter, charge) if out is None else out.when(aa == letter, charge)
    return out.otherwise(0.0)


def residue_charge_ph(
    aa: Column, pos: Column, n: Column, p: ChargeParams = ChargeParams()
) -> Column:
    """Side chain plus the terminus the residue carries, so regions add up to the whole."""
    first, last = terminal_charges(p)
    return (
        side_chain_charge(aa, p)
        + F.when(pos == 0, first).otherwise(0.0)
        + F.when(pos == n - 1, last).otherwise(0.0)
    )


def net_charge_ph(seq: Column, p: ChargeParams = ChargeParams()) -> Column:
    total = F.lit(sum(terminal_charges(p)))
    for letter, charge in letter_charges(p).items():
        total = total + count_letters(seq, letter) * F.lit(charge)
    return total


def residue_charge(definition: str, aa: Column, pos: Column, n: Column, p=ChargeParams()) -> Column:
    if definition == "simple":
        return residue_charge_simple(aa).cast("double")
    if definition == "ph":
        return residue_charge_ph(aa, pos, n, p)
    raise ValueError(f"charge definition must be 'simple' or 'ph', got {definition!r}")


def definition_tag(definition: str, p: ChargeParams = ChargeParams()) -> str:
    return "simple" if definition == "simple" else f"ph{p.ph:g}_{p.pka_set}".replace(".", "_")


# The candidate definitions a reported charge is compared with.
CANDIDATES: dict[str, Callable[[Column], Column]] = {
    "simple_KR_minus_DE": lambda s: net_charge_simple(s).cast("double"),
    "ph7.4_emboss": lambda s: net_charge_ph(s, ChargeParams(7.4, "emboss")),
    "ph7.4_bjellqvist": lambda s: net_charge_ph(s, ChargeParams(7.4, "bjellqvist")),
    "ph7.4_emboss_no_termini": lambda s: net_charge_ph(s, ChargeParams(7.4, "emboss", termini=False)),
    "ph7.4_emboss_no_cys_tyr": lambda s: net_charge_ph(s, ChargeParams(7.4, "emboss", cys_tyr=False)),
    "ph7.0_emboss": lambda s: net_charge_ph(s, ChargeParams(7.0, "emboss")),
    "ph7.0_bjellqvist": lambda s: net_charge_ph(s, ChargeParams(7.0, "bjellqvist")),
}


def density(charge: Column, n: Column) -> Column:
    """Charge per residue, 0 for an empty region."""
    return F.coalesce(F.try_divide(charge.cast("double"), n), F.lit(0.0))
