"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("site_tree", "backoff_lm", "sos_packing", "license_automaton", "url_rules", "minhash_join", "decontaminate", "secret_scan", "byte_cnn", "quality_mcd", "importance_resampling", "projection_forest", "ranked_search")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
