"""Run a registered query and its SQL on the same files and compare the results."""

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v))
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name, build, sql, sf_dir):
    """None when equal, else a text describing the first difference."""
    df = build(spark, sf_dir)
    got_cols, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    want_cols, want = table_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[0][0]} != {bad[0][1]}"
    for i, c in enumerate(got_cols):
        kinds = {kind(r[i]) for r in got if r[i] is not None} ^ {kind(r[i]) for r in want if r[i] is not None}
        if kinds:
            return f"column {c} has different types {kinds}"
    return None
