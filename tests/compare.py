"""Rows of a query against rows of its SQL, without order; numbers within a relative 1e-9."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def difference(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.sql(sql)
    names = sorted(found.columns)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {names}"
    key = lambda r: tuple((x is not None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in r)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    at = [found.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ("no rows" if not ours else "")
