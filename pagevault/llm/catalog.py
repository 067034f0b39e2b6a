"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pagevault.llm import decontaminate, embedding_near, language_id, license_scan, line_dedup, mixing, ngram_join, periodic_runs, pii, progressive_jpeg, secret_scan, spelling_variants, toxicity

MODULES = (secret_scan, line_dedup, toxicity, pii, decontaminate, progressive_jpeg, mixing, language_id, ngram_join, license_scan, embedding_near, periodic_runs, spelling_variants)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
