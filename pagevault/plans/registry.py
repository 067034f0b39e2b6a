"""Queries over the archive by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pagevault.plans import budget, engine, indexing, pages, retrieval, streams, texts

MODULES = (indexing, retrieval, pages, budget, streams, engine, texts)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
