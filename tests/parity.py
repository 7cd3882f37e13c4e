"""Runs a query and its SQL side by side and compares rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def oracle(sql: str, sf: str = SF, views: dict[str, str] | None = None):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{(views or {}).get(t, f'{sf}/{t}.parquet')}')")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        return names, got.fetchall()


def same(df, sql: str, sf: str = SF, views: dict[str, str] | None = None) -> int:
    names, rows = oracle(sql, sf, views)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(clean(r[names.index(c)]) for c in order) for r in rows), key=key)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (order, a, b)
    return len(got)
