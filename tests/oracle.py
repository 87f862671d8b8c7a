"""Runs a query and its SQL twin and compares columns, types and values."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def kind(type_name):
    text = str(type_name).lower()
    groups = {
        "bigint": "bigint", "int": "int", "integer": "int", "double": "double", "boolean": "boolean",
        "string": "string", "varchar": "string", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
    }
    return groups.get(text, text)


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(df, con, sql):
    """Empty text if both agree."""
    twin = con.execute(sql)
    twin_types = {c[0]: kind(c[1]) for c in twin.description}
    names = sorted(df.columns)
    if names != sorted(twin_types):
        return f"columns {names} / {sorted(twin_types)}"
    types = {name: kind(t) for name, t in df.dtypes}
    if types != twin_types:
        return f"types {types} / {twin_types}"
    at = [list(twin_types).index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=sort_key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=sort_key)
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    for a, b in zip(got, want):
        if not all(map(same, a, b)):
            return f"{a} / {b}"
    return ""
