"""Runs a registered query and its reference SQL on the same folder and compares names, types and rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from tallyscope.sources.model import TABLES, Model

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
    "float": "FLOAT",
}


def engine(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(data) -> list[tuple]:
    return sorted((tuple(cell(v) for v in r) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def problems(spark, con, folder: str, build, sql: str | None) -> tuple[str, int]:
    """('' or what differs, number of rows)."""
    df = build(Model(spark, folder))
    names = sorted(df.columns)
    got = rows(df.select(*names).collect())
    if sql is None:
        return ("" if got else "no rows"), len(got)
    desc = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    if sorted(desc) != names:
        return f"columns {names} != {sorted(desc)}", len(got)
    kinds = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if kinds != desc:
        return f"types { {n: (kinds[n], desc[n]) for n in names if kinds[n] != desc[n]} }", len(got)
    want = rows(con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else "" if got else "both empty"), len(got)
