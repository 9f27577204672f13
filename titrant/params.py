"""Tunable parameters, grouped by the operator family that reads them."""

from dataclasses import dataclass


@dataclass(frozen=True)
class RegionParams:
    delta_area_threshold: float = 1.0
    contact_cutoff: float = 5.0
    core_relative_area_max: float = 0.25
    probe_radius: float = 1.4
    sphere_points: int = 100


@dataclass(frozen=True)
class ChargeParams:
    ph: float = 7.4
    pka_set: str = "emboss"
    cys_tyr: bool = True
    termini: bool = True
    tolerance: float = 0.51


@dataclass(frozen=True)
class BridgeParams:
    cutoff: float = 4.0
    proxy_cutoff: float = 6.0
    histidine: bool = False


@dataclass(frozen=True)
class AtomParams:
    model_index: int = 0
    drop_hydrogens: bool = True
    altlocs: tuple = ("", " ", "A")

