"""Compare a query with its SQL in DuckDB, as multisets of rows with numbers to six digits."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.5g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return f"{v.isoformat()}T00:00:00"
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
