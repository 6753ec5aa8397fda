"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("fixity", "packing", "pieces", "templates", "private", "quality", "substrings", "neighbours", "languages", "simhash", "periodic", "filters", "lines")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"inkwell.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
