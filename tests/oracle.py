"""Order-insensitive comparison of a Spark query with DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(key(r[i]) for i in order) for r in data)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = rel.columns
    assert sorted(df.columns) == sorted(cols)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, rel.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, [x for x in zip(mine, theirs) if x[0] != x[1]][:3]
