"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value, digits):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr((value if digits is None else round(value, digits)) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v, digits) for v in value) + "]"
    return str(value)


def normal_rows(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i], digits) for i in order) for r in rows)


def compare(spark_df, db, sql, digits=None):
    """None if both agree, else a text that says how they differ."""
    got_cols, got = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()], digits)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want_cols, want = normal_rows(names, result.fetchall(), digits)
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}"
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first: {wrong[0]}"
    return None
