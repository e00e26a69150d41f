"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLES.
MODULES: list[str] = ["similar_queries", "cluster_queries", "split_queries", "handwritten_queries", "residue_queries", "documented_queries", "token_queries", "syntax_queries"]


def _all(what: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"strataloom.llm.{m}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
