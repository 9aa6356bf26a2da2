"""Side-by-side comparison of a registered query and its DuckDB text."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(data=DATA):
    con = duckdb.connect()
    con.sql("set threads=4; set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def differences(spark, query, sql, data=DATA, con=None):
    """What differs, as text; empty if nothing does."""
    a = query(spark, data).toPandas()
    b = (con or connect(data)).sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    cols = sorted(a.columns)

    def norm(x):
        x = x[cols].copy()
        for c in cols:
            if str(x[c].dtype).startswith("datetime"):
                x[c] = x[c].dt.strftime("%F %T")
            elif pd.api.types.is_numeric_dtype(x[c]):
                x[c] = x[c].astype(float) + 0.0
        x = x.astype(object).where(x.notna(), None)
        return sorted(map(repr, x.itertuples(index=False, name=None)))

    p, q = norm(a), norm(b)
    bad = [(x, y) for x, y in zip(p, q, strict=True) if x != y]
    return f"{len(bad)} of {len(p)} rows, first {bad[0]}" if bad else ""
