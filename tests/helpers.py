"""Comparison of a query with its SQL."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x != x:
        return "None"
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
