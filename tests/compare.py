"""Rows of a query and of its SQL as comparable text."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "NaN" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) > 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
