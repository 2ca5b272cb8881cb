"""All registered queries of the engine."""

from __future__ import annotations

from . import aggregates, basic, dialects, joins, reports, subqueries  # noqa: F401  they register themselves
from .register import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
