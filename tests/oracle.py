"""Compares a query's rows with those of its SQL in DuckDB: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA / sf / (t + '.parquet')}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(plain, v)) + "]"
        return repr(v)

    return [names[i] for i in order], sorted("|".join(plain(r[i]) for i in order) for r in rows)


def difference(df, sql: str, sf: str) -> str:
    """Empty if both agree, else what differs first."""
    names, rows = canonical(*spark_rows(df))
    names2, rows2 = canonical(*duck_rows(sql, sf))
    if names != names2:
        return f"columns {names} and {names2}"
    if len(rows) != len(rows2):
        return f"{len(rows)} rows and {len(rows2)}; first differing: {next(((a, b) for a, b in zip(rows, rows2) if a != b), None)}"
    wrong = [(a, b) for a, b in zip(rows, rows2) if a != b]
    return f"{len(wrong)} of {len(rows)} rows, such as {wrong[0]}" if wrong else ""
