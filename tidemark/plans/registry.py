"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import compare_queries, ingest_queries, skill_queries, stat_queries

MODULES = (skill_queries, stat_queries, compare_queries, ingest_queries)


def queries():
    return {k: f for module in MODULES for k, f in module.QUERIES.items()}


def oracle_sql():
    return {k: s for module in MODULES for k, s in module.SQL.items()}
