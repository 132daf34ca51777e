"""Run SQL twins in DuckDB and compare rows, columns, types and values."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or not math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6):
            return False
        return bool(a or b) or math.copysign(1, a) == math.copysign(1, b)  # 0.0 isn't -0.0
    if isinstance(a, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and type(a) is type(b)


def compare(df, con, sql):
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    key = lambda row: tuple((v is not None, str(v) if not isinstance(v, float) else f"{v:.4f}") for v in row)
    got.sort(key=key)
    want.sort(key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert same(a, b), (a, b)
