"""Registry of the library's queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable, sql: str | None = None) -> None:
    """Adds a query (of session and folder) and, where SQL expresses it, its DuckDB SQL."""
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def load() -> None:
    for module in ("cooccurrence", "relational", "retrieval", "curation", "sources"):
        import_module(f"tessera.plans.{module}")
