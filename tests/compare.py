"""Run a registered query and its SQL check, and compare the two results."""

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, decimal.Decimal)):
        return "int" if value == int(value) else "decimal"
    return type(value).__name__


def plain(value):
    if isinstance(value, decimal.Decimal) and value == int(value):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def difference(df, con, sql: str) -> str | None:
    """NULL when both results hold the same rows; otherwise what differs."""
    cols = sorted(df.columns)
    left = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    types = {}
    for rows, side in ((left, "spark"), (right, "check")):
        for row in rows:
            for c, v in zip(cols, row):
                if v is not None:
                    types.setdefault((c, side), kind(v))
    for c in cols:
        a, b = types.get((c, "spark")), types.get((c, "check"))
        if a and b and a != b:
            return f"column {c} is {a} here, {b} in the check"
    a, b = Counter(left), Counter(right)
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        return (
            f"{len(left)} rows, check {len(right)}; {cols}\n only here {len(only_a)}: "
            f"{sorted(only_a, key=str)[:3]}\n only check {len(only_b)}: {sorted(only_b, key=str)[:3]}"
        )
    return None
