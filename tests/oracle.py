"""Runs a query's SQL in DuckDB and compares the rows, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v) -> str:
    if v is None or v is pd.NaT or (not isinstance(v, (list, str)) and pd.isna(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, str):
        return v
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


def same(spark_df, sql: str, con) -> None:
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
