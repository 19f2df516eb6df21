"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def cte(name: str, sql: str) -> None:
    """A derived table that oracle SQL may use by name."""
    CTES[name] = sql


def oracle(name: str) -> str:
    """The oracle SQL of a query, preceded by the derived tables it uses."""
    body, needed = ORACLES[name], []

    def visit(sql: str) -> None:
        for used in CTES:
            if used not in needed and re.search(rf"\b{used}\b", sql):
                visit(CTES[used])
                if used not in needed:
                    needed.append(used)

    visit(body)
    if not needed:
        return body
    recursive = "RECURSIVE " if "RECURSIVE_STEP" in body or any("RECURSIVE_STEP" in CTES[n] for n in needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body
