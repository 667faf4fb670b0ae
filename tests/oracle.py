"""Runs a query beside its SQL and compares the rows as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = os.environ.get("LOOMTREE_TESTDATA", "/root/testdata")


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return value


def sql_rows(sql: str, sf: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
