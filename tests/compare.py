"""A query's rows against those of its DuckDB SQL, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal, float)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def differences(spark, run, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    names, found = oracle(sql, sf_dir)
    want = rows_of(names, found)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        left, right = set(got), set(want)
        a, b = [r for r in got if r not in right][:2], [r for r in want if r not in left][:2]
        return f"{len(got)} and {len(want)} rows; only Spark: {str(a)[:700]}; only SQL: {str(b)[:700]}"
    return ""
