"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return v.item()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def difference(df, sql: str, sf_dir: str) -> str:
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    more, less = a[1] - b[1], b[1] - a[1]
    return f"{sum(more.values())} rows more, {sum(less.values())} fewer of {sum(b[1].values())}: {list(more)[:2]} {list(less)[:2]}" if more or less else ""
