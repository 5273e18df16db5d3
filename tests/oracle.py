"""Compares a Spark result with DuckDB's on the same tables: columns by name, rows without order."""

import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(df, con, sql):
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == columns, (sorted(names), columns)
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in q.fetchall())
    if got != want:
        missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
        raise AssertionError(f"columns {columns}\nmissing {missing}\nextra {extra}\n{sum(got.values())} and {sum(want.values())} rows")
    return sum(got.values())
