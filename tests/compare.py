"""Spark results against DuckDB on one folder: names of queries that differ."""

import math

import duckdb


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return v.item()
    return v


def differs(spark, name, f, sql, sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    rows = want.fetchall()
    got = f(spark, sf_dir)
    if sorted(got.columns) != sorted(cols):
        return f"{name}: columns {sorted(got.columns)} and {sorted(cols)}"
    order = sorted(cols)
    a = sorted(([canon(r[c]) for c in order] for r in got.collect()), key=repr)
    b = sorted(([canon(dict(zip(cols, r, strict=True))[c]) for c in order] for r in rows), key=repr)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
        return f"{name}: {len(a)} and {len(b)} rows, first difference {first}"
    return None
