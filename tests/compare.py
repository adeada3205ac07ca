"""Rows of a Spark query against those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return v if isinstance(v, str) else round(float(v), 6) if hasattr(v, "__float__") else str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def check(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
