"""A Spark result against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("Int") and frame[c].hasnans:  # Spark's integers with nulls come as floats
            frame[c] = frame[c].astype("float64")
        if str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].round(9)
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def same(result, sql: str, folder: str) -> None:
    want = connect(folder).execute(sql).df()
    got = result.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
