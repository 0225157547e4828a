"""How a query is registered: a function of (spark, sf_dir), and SQL over the canonical tables."""

from __future__ import annotations

from tapeloom.sources.market import VIEWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """sql: a SELECT, or further table expressions from a leading comma on and then a SELECT."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {'RECURSIVE ' * recursive}{VIEWS}{sql}"
        return f

    return add


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
