"""Run a registered query and its SQL twin on the same files and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from gustfront.catalog.views import TABLES


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0) if value else "0.0"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(columns), sorted(tuple(canonical(r[n]) for n in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, folder, build, twin, con=None):
    got_df = build(spark, folder)
    got_cols, got = rows_of(got_df.columns, got_df.collect())
    con = con or connect(folder)
    cur = con.execute(twin)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_cols == want_cols, f"columns {got_cols} != {want_cols}"
    assert len(got) == len(want), f"rows {len(got)} != {len(want)}; only spark {list(set(got) - set(want))[:3]} only twin {list(set(want) - set(got))[:3]}"
    if got != want:
        from collections import Counter

        mine, theirs = sorted((Counter(got) - Counter(want)).elements()), sorted((Counter(want) - Counter(got)).elements())
        raise AssertionError(f"{len(mine)} rows differ, e.g. spark {mine[:3]} twin {theirs[:3]}")
    return len(got)
