"""Comparison of a query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    return x if isinstance(x, (int, bool, type(None))) else str(x)


def same(frame, db, sql: str) -> tuple[list, list]:
    """Both results as sorted rows, columns by name."""
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    rel = db.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return got, want
