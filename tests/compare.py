"""Row-by-row comparison of a query with its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(float(v)) if isinstance(v, float) else repr(v)


def assert_same(df, con, sql):
    got = df.collect()
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = {c: i for i, c in enumerate(rel.columns)}
    a = sorted(tuple(str(_plain(r[c])) for c in names) for r in got)
    b = sorted(tuple(str(_plain(r[at[c]])) for c in names) for r in rel.fetchall())
    assert a == b
