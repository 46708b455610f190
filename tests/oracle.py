"""Compare a query with its SQL twin on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.6f}"
        return "null" if v is None else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def assert_same(df, connection, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
