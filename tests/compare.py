"""Compare a query with its SQL: same columns, same multiset of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else value
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, con) -> list[str]:
    """Empty when the two results agree."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = multiset(result.fetchall(), columns)
    actual = multiset(df.collect(), df.columns)
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns: spark {sorted(df.columns)} sql {sorted(columns)}")
    if actual != expected:
        extra, lacking = actual - expected, expected - actual
        problems.append(
            f"rows: spark {actual.total()} sql {expected.total()}, "
            f"only spark {list(extra.items())[:3]}, only sql {list(lacking.items())[:3]}"
        )
    return problems
