"""All queries of the core, by name."""

from __future__ import annotations

from papyrine.plans import cleaning_queries, formula_queries, graph_queries, interpretation_queries, interval_queries, more_queries, p1, p2, p3, relation_queries, repair_queries, rollup_queries, search_queries, text_queries, validation_queries

MODULES = [p1, p2, p3, text_queries, graph_queries, formula_queries, more_queries, interval_queries, repair_queries, relation_queries, search_queries, validation_queries, cleaning_queries, interpretation_queries, rollup_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
