"""Comparison of query results with DuckDB over the same Parquet tables."""

import math
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([_cell(y) for y in x])
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if isinstance(x, (int, float)) or "int" in type(x).__name__:
        return f"{float(x):.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def connect(sf_dir: str = SF):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def agree(spark, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
