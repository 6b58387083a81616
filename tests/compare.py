"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return float(round(float(v), 5))
    return str(v)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).values.tolist())


def by_sql(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c.sql(sql).df()
