"""Registered queries. Importing a module registers what it defines."""

from __future__ import annotations

from importlib import import_module

from corpusq.plans.registry import ORACLE, QUERIES, Query

MODULES = ["retrieval", "cells", "chunks", "symbols", "outlines", "conversations", "indexing", "runs", "streams"]


def _load() -> None:
    for name in MODULES:
        import_module(f"corpusq.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
