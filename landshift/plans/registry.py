"""Query registry and the shared SQL definitions of the observation tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
STORED: set[str] = set()  # views that are computed once per statement


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may use the names in VIEWS as tables."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def view(name: str, sql: str, stored: bool = False) -> None:
    VIEWS[name] = sql
    if stored:
        STORED.add(name)


def _uses(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(from|join)\s+{v}\b", sql, re.IGNORECASE)]


def expand(sql: str) -> str:
    """Prepend the WITH list a statement needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _uses(VIEWS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _uses(sql):
        visit(name)
    if not order:
        return sql
    head = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in STORED else ''}({VIEWS[name]})" for name in order)
    body = sql.strip()
    if re.match(r"with\s+recursive\s", body, re.IGNORECASE):
        return f"WITH RECURSIVE {head},\n{re.sub(r'^with\s+recursive\s', '', body, flags=re.IGNORECASE)}"
    if re.match(r"with\s", body, re.IGNORECASE):
        return f"WITH {head},\n{re.sub(r'^with\s', '', body, flags=re.IGNORECASE)}"
    return f"WITH {head}\n{body}"
