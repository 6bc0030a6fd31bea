"""Compares a query with its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import decimal
import glob
import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v) -> str:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 6) + 0.0)
    return str(float(v)) if isinstance(v, int) else str(v)


def agree(spark, con, query, sql) -> None:
    df = query(spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in cols) for row in df.collect()) == want
