"""Holds a query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(spark, query, sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, expected = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    cols = sorted(found.columns)

    def key(df):
        return sorted(repr([None if not isinstance(v, (list, tuple)) and pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in r]) for r in df[cols].astype(object).values.tolist())

    return key(found), key(expected)
