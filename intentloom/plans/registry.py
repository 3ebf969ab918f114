"""All queries of the intent library with their SQL counterparts."""

from __future__ import annotations

from intentloom.plans import chat, intake, runs, web

_PARTS = (intake, web, chat, runs)


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
