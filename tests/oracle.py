"""Compare a query's rows with its oracle SQL's."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows, and what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    actual = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(names) != sorted(df.columns):
        return len(actual), [f"columns {sorted(df.columns)} != {sorted(names)}"]
    a, b = rows(df.columns, actual), rows(names, expected)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows, expected {len(b)}")
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        problems += [f"only spark: {x[:300]}" for x in sorted(sa - sb)[:3]] + [f"only sql: {x[:300]}" for x in sorted(sb - sa)[:3]]
        if not (sa - sb or sb - sa):
            problems.append("repeated rows differ")
    return len(actual), problems
