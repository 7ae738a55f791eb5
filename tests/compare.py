"""Rows of a Spark query and of its SQL in DuckDB, in comparable form."""

from __future__ import annotations

import os

import duckdb


def plain(v):
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    return v.tolist() if hasattr(v, "tolist") else v


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con.sql(sql).df()
