"""Registered queries, and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def values(rows: Sequence[Sequence], columns: str) -> str:
    """The rows as a SQL table expression, for twins of queries over literal relations."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, list | tuple):
            return "[" + ", ".join(map(one, x)) + "]"
        return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


def rounded(column: str, digits: int = 6) -> str:
    return f"round({column}, {digits})"
