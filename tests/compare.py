"""Compare registered queries with their SQL: row count, columns and values."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str):
    """None when equal, else a short description."""
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    ours, theirs = _rows(df.columns, df.collect()), _rows(relation.columns, relation.fetchall())
    if ours != theirs:
        return (f"rows {sum(ours.values())} / {sum(theirs.values())}; only ours "
                f"{list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}; "
                f"columns {sorted(df.columns)}")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
    types = dict(zip(relation.columns, map(str, relation.types)))
    odd = [(c, k, types[c]) for c, k in df.dtypes if kinds.get(k, types[c]) != types[c]]
    return f"types {odd}" if odd else None
