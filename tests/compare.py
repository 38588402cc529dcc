"""Runs queries next to their SQL oracles and compares the rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, Decimal)):
        return "int" if isinstance(value, int) else "float"
    return type(value).__name__


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple], dict[str, set]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    kinds: dict[str, set] = {n: set() for n in names}
    out = []
    for row in rows:
        for i in order:
            if row[i] is not None:
                kinds[columns[i]].add(kind(row[i]))
        out.append(tuple(norm(row[i]) for i in order))
    return names, sorted(out, key=repr), kinds


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences."""
    ours = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    theirs = rows_of([d[0] for d in answer.description], answer.fetchall())
    problems = []
    if ours[0] != theirs[0]:
        return len(ours[1]), [f"columns {ours[0]} against {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        problems.append(f"{len(ours[1])} rows against {len(theirs[1])}")
    for name in ours[0]:
        a, b = ours[2][name], theirs[2][name]
        if a and b and a != b:
            problems.append(f"{name}: {a} against {b}")
    missing = set(map(repr, ours[1])) ^ set(map(repr, theirs[1]))
    if missing:
        extra = [r for r in ours[1] if repr(r) in missing][:2]
        lost = [r for r in theirs[1] if repr(r) in missing][:2]
        problems.append(f"{len(missing)} rows differ, such as {extra} against {lost}")
    return len(ours[1]), problems
