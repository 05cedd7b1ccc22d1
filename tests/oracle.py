"""Runs a query's oracle SQL in DuckDB and compares rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(rows, columns):
    shown = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in rows), sorted(columns)


def same(df, con, sql):
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(cursor.fetchall(), names)
    assert got[1] == want[1]
    assert got[0] == want[0], ([r for r in got[0] if r not in set(want[0])][:3], [r for r in want[0] if r not in set(got[0])][:3])
    return len(got[0])
