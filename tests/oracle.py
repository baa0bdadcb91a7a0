"""Runs a registered query beside its SQL in DuckDB and compares all rows."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_value(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return f"{float(v):.6g}" if abs(float(v)) < 1e6 else str(int(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck(sf_dir).sql(sql)
    want = rows(list(found.columns), found.fetchall())
    assert sorted(df.columns) == sorted(found.columns), (df.columns, found.columns)
    assert len(got) == len(want), (len(got), len(want))
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    assert not odd, (len(odd), odd[:3])
    return len(got)
