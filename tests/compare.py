"""Rows of Spark and of DuckDB in a form that can be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    return round(value, 4) if isinstance(value, float) else value


def rows(found) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple(map(str, r)))


def spark_rows(df) -> list[tuple]:
    return rows(df.select(*sorted(df.columns)).collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], rows(tuple(r[i] for i in order) for r in cur.fetchall())
