"""Collects the registered queries and their DuckDB oracle SQL from every plan module."""

from __future__ import annotations

import importlib

MODULES = ["retrieval", "evaluation", "corpus", "search", "chat", "denoise", "ops", "pipeline"]


def _mods():
    return [importlib.import_module(f"quarry.plans.{m}") for m in MODULES]


def queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _mods():
        out.update(getattr(m, "SQL", {}))
    return out
