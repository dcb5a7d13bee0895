"""Runs a query and its SQL twin and compares them as bags of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = bag(cur.fetchall(), names)
    have = bag([tuple(r) for r in got.collect()], got.columns)
    assert have[0] == want[0]
    assert have[1] == want[1]
