"""Runs registered queries and their SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return v
    return v if isinstance(v, str) else str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = database(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    want = rows_of(names, rel.fetchall())
    assert len(got) == len(want), (name, len(got), len(want), got[:2], want[:2])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, len(bad), str(bad[0])[:1500])
