"""Runs a query beside its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TESTDATA = "/root/testdata/sf0.001"


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql: str, folder: str = TESTDATA) -> None:
    mine = query(spark, folder).toPandas()
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    theirs = con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
