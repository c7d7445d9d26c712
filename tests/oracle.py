"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return con


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) or "" for i in order) for r in data)


def compare(spark, con, query, sql, folder):
    """None if both give the same rows, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} / {names}"
    if got != want:
        only = [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]
        return f"{len(got)} / {len(want)} rows; {only}"
    return None
