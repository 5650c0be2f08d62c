"""Spark rows against DuckDB's over one folder of test tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def duck(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame, columns):
    text = lambda x: "" if x is None or str(x) in ("nan", "<NA>", "None") else str(x)
    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


def assert_same(df, sql, folder):
    got, want = df.toPandas(), duck(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:  # integers with nulls come as floats from one side
        if str(want[c].dtype).startswith("Int"):
            got[c] = got[c].astype(want[c].dtype)
    assert rows(got, columns) == rows(want, columns)
