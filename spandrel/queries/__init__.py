"""Named queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from . import analysis, evaluation, logs, structure, texts

_PARTS = (evaluation, logs, texts, analysis, structure)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracles() -> dict:
    return {k: v for part in _PARTS for k, v in part.ORACLES.items()}
