"""Runs a query and its oracle SQL over the same tables and compares the rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            src = f"{p}/*.parquet" if os.path.isdir(p) else p
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{src}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return repr(v) if isinstance(v, str) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in rows)


def check(spark, entry, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:3]
    return len(got[1])
