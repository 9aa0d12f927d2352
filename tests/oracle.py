"""Comparing a registered query with its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


def same(df, db, sql):
    relation = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(_value(r[c]) for c in names) for r in df.collect()), key=repr)
    rows = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    theirs = sorted((tuple(_value(r[c]) for c in names) for r in rows), key=repr)
    assert ours == theirs
    return len(ours)
