"""A Spark result against DuckDB's on the same Parquet tables: names, types by kind, and all rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def difference(df, sf_dir: str, sql: str) -> str:
    """Nothing if they agree, else what differs."""
    names, rows = duck(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(df.columns)
    kind = lambda x: "number" if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else type(x).__name__
    own = [tuple(r[c] for c in order) for r in df.collect()]
    other = [tuple(r[names.index(c)] for c in order) for r in rows]
    for k, c in enumerate(order):
        kinds = [{type(r[k]).__name__ for r in x if r[k] is not None} for x in (own, other)]
        if kinds[0] != kinds[1] and kinds[0] and kinds[1]:
            return f"{c}: {kinds[0]} and {kinds[1]}"
    a, b = (Counter(tuple(map(plain, r)) for r in x) for x in (own, other))
    extra, missing = list((a - b).elements()), list((b - a).elements())
    if extra or missing:
        return f"{len(own)} and {len(other)} rows, {order}: only here {len(extra)} {sorted(extra, key=str)[:3]}, only there {len(missing)} {sorted(missing, key=str)[:3]}"
    return "" if own else "no rows"
