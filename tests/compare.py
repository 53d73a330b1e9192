"""A query's rows against its DuckDB twin's: names, number and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x: object) -> object:
    """A value that equal results of both engines share; numbers at 6 digits."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | float | decimal.Decimal):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows_of(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def of_spark(df) -> tuple[list[str], Counter]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    (names, mine), (twin_names, twin) = of_spark(df), of_duckdb(sql, sf_dir)
    if names != twin_names:
        return f"columns {names} and {twin_names}"
    if mine != twin:
        return f"{sum(mine.values())} and {sum(twin.values())} rows; only here {list((mine - twin).items())[:3]}; only there {list((twin - mine).items())[:3]}"
    return ""
