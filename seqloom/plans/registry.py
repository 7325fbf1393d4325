"""Where plans register their queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plain_zero(sql: str) -> str:
    """``sql`` with 0 added to each rounded value: DuckDB rounds small negative values to -0.0, Spark to 0.0."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append((m.start(), end))
    marks = sorted([(s, "(") for s, _ in out] + [(e, " + 0)") for _, e in out])
    parts = []
    for where, text in marks:
        parts += [sql[at:where], text]
        at = where
    return "".join([*parts, sql[at:]])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is what DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = plain_zero(sql)
        return f

    return add
