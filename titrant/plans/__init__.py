"""Every registered query, grouped by the study step it belongs to."""

import importlib

GROUPS = (
    "sequence", "pairing", "inference", "spatial", "matrix", "contract", "work", "files", "structure",
)


def load() -> None:
    for group in GROUPS:
        importlib.import_module(f"titrant.plans.{group}_queries")
