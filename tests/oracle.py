"""Holds registered queries against their SQL on DuckDB, as unordered rows."""

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(cell, x)) if isinstance(x, list | tuple) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, query, sql):
    """Empty if columns and rows agree, else what doesn't."""
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = db.sql(sql)
    df = query(spark, sf_dir)
    names, expected = rows_of(want.columns, want.fetchall())
    own, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != own:
        return [names, own]
    return [list((expected - got).items())[:3], list((got - expected).items())[:3]] if got != expected else []
