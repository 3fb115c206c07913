"""A query's rows against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def differences(spark, query, sql: str, sf: str = SF) -> list:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    df = query(spark, sf)
    assert sorted(df.columns) == names
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    return [] if got == want else [(len(got), len(want)), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3]]
