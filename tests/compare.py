"""Rows of a query and of its SQL in one form."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v) -> str:
    if isinstance(v, list | tuple | np.ndarray):
        return str([value(x) for x in v])
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return "NULL"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(map(value, r)) for r in df[cols].itertuples(index=False))


def agree(frame, sql: str, sf: str = SF) -> int:
    ours, theirs = frame.toPandas(), connect(sf).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    return len(ours)
