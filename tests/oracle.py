"""Compares a query with its SQL, as sets of rows."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def rows_of_df(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
