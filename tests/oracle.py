"""Runs a query and its SQL on the same tables and compares names, types and rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    result = connect(sf_dir).execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    order = [list(kinds).index(n) for n in names if n in kinds]
    wanted = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    assert names == sorted(kinds)
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == kinds
    assert found == wanted
    return len(found)
