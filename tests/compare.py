"""Rows of a query and of its oracle in comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(normal(x) for x in r) for r in df.select(*columns).collect()), key=repr)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in found.fetchall()), key=repr)
