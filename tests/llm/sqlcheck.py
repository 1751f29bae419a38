import os

import duckdb

TABLES = "documents pages benchmark labels conversations".split()


def equal(df, sql, sf):
    """Whether a query's rows are those of its SQL, at this size."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = df.select(names).collect()
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.project(", ".join(names)).fetchall()))


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        os.makedirs(tmp_path, exist_ok=True)
        df.toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
