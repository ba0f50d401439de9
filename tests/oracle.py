"""Runs a query and its SQL on another engine and compares rows without order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(frame, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    other = con.sql(sql)
    cols = sorted(frame.columns)
    assert cols == sorted(other.columns)
    at = [other.columns.index(c) for c in cols]
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert mine == theirs
