"""Compares a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=key)
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert got == expected
    return len(got)
