"""Registered queries: each operator over the given tables, with its SQL counterpart."""

from catalog import answers, audit, ingest, ranking, scoring, state, texts

MODULES = (ingest, state, texts, answers, scoring, ranking, audit)


def queries() -> dict:
    return {name: fn for module in MODULES for name, (fn, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
