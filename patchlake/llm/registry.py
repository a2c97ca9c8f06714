"""Queries and oracle SQL of the operators for training data."""

from __future__ import annotations

from patchlake.llm import credentials, encode, generated, lookalike, mixture, overlap, percentiles, pieces, splits, syntax

_MODULES = (percentiles, credentials, splits, pieces, generated, syntax, overlap, encode, mixture, lookalike)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in vars(m).items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
