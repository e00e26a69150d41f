"""Registered queries of the core: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from strataloom.plans import extraction, hierarchies, maps, repository, search, vectors

_MODULES = [hierarchies, repository, extraction, maps, search, vectors]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
