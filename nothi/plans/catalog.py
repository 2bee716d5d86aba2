"""Every query of the engine outside the optional subpackage, with its SQL."""

from __future__ import annotations

from nothi.plans import queries_activity, queries_correct, queries_layout, queries_search, queries_store, queries_text  # noqa: F401
from nothi.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
