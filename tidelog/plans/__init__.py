"""Registered queries over the given tables, one module for each group of operators."""

from tidelog.plans import aliases, evidence, extract, memory, search, store, stream, timeline, work  # noqa: F401
from tidelog.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
